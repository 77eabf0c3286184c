"""Registered queries and their SQL."""

from . import audio, oracle, queries, reading, rules, site, stored, streams, styles, values

QUERIES = queries.QUERIES | values.QUERIES | audio.QUERIES | site.QUERIES | reading.QUERIES | rules.QUERIES | stored.QUERIES | streams.QUERIES | styles.QUERIES
ORACLE = oracle.ORACLE | values.ORACLE | audio.ORACLE | site.ORACLE | reading.ORACLE | rules.ORACLE | stored.ORACLE | streams.ORACLE | styles.ORACLE
