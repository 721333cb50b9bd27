"""Cohort cleaning and the demand, rider, fleet, distance and model questions."""
