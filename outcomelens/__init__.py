"""Outcome analytics on Spark: staging, cohort, rates, scores, risk model, odds ratios."""
