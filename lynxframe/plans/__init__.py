"""The catalogue of queries; importing this package registers all of them."""

from lynxframe.plans import boxes, catalogue, evidence, gates, lineage, links, memories, picks, reviews, scalars, scenes, scores, states, tables  # noqa: F401
