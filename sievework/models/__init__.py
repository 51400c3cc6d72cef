"""Classifiers: ``fit`` on a training table, ``predict`` adds ``prediction`` and score columns."""
