"""Operators of a training-data pipeline (see README, "Training-data operators").

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
