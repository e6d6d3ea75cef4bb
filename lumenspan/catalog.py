"""Imports every module that registers queries."""

from lumenspan.operators import catalogue, details, evidence, extraction, readmodel, rollup, rules, sources_report, spans  # noqa: F401
from lumenspan.plans import jobs, refresh, throttle  # noqa: F401
from lumenspan.sources import exports, passport, payloads, sinks  # noqa: F401
from lumenspan.streaming import queue  # noqa: F401
