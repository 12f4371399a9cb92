"""Registered queries and their SQL."""

from . import cause_queries, delay_queries, parse_queries, ride_queries, scalar_queries, stream_queries, timetable_queries, weather_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "cause_queries", "delay_queries", "parse_queries", "ride_queries", "scalar_queries", "stream_queries", "timetable_queries", "weather_queries"]
