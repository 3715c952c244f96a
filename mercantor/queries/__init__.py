"""All registered queries; importing this package fills the registry."""

from . import aggregates, browse, feeds, filters, judging, learning, lookups, planning, quality, state, texts  # noqa: F401
