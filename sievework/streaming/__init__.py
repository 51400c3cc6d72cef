"""Streaming use.

There is no streaming operator here. What streams is the *apply* half of a fitted step: imputing,
capping, scaling, recoding and naive Bayes prediction are projections with literals, so they take
a streaming DataFrame as they take a batch one. Fitting is batch work.
"""
