"""Query plans over the domain tables; importing this package registers them."""

from lumenloom.plans import cubes, dedup, evaluation, grounding, language, longform, marts, products, reports, review, sampling, sources, statistics, text, themes, topics  # noqa: F401
