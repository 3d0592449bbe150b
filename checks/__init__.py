"""Registered queries with the SQL that must give the same rows.

Each module holds CASES: name -> (callable(spark, folder), SQL or None).
"""

from . import chart_cases, ml_cases, profile_cases, text_cases, tools_cases

MODULES = (tools_cases, profile_cases, chart_cases, ml_cases, text_cases)
