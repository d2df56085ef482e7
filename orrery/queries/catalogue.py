"""Imports every module that registers queries."""

from orrery.queries import clustering, companies, exports, linking, loading, matching, names, news, people, ranked, relational, search, textual  # noqa: F401
