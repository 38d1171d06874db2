"""All queries over the reference operators, with the SQL that checks them."""

from __future__ import annotations

from waywarden.plans import area, checks, judgement, motion, samples

MODULES = (motion, judgement, area, checks, samples)


def flagship(spark, sf_dir):
    return motion.window_residuals(spark, sf_dir)


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
