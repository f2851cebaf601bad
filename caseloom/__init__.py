"""Encounter analytics on Spark: cleaning, comorbidity scoring, cohort profiles, narratives, sampling, models."""
