"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from loomwright.llm import answers, conversations, leaks, overlaps, pieces, pii, representatives, tokens

QUERIES = answers.QUERIES | conversations.QUERIES | leaks.QUERIES | overlaps.QUERIES | pieces.QUERIES | pii.QUERIES | representatives.QUERIES | tokens.QUERIES
ORACLES: dict[str, str] = conversations.ORACLES | pieces.ORACLES
