"""Registered queries: importing this package fills :mod:`lodestone.plans.registry`."""

from . import registry
from . import aggregates, corpus, evaluation, evidence, filters, joins, mutations, references, reports, retrieval, sampling, texts, windows  # noqa: F401
