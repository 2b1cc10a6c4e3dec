"""Conjecture cards: registered before the result, immutable, with verdicts."""

from __future__ import annotations

import hashlib
import json

from kinforge.infra.artifacts import ArtifactRegistry

OUTCOMES = ("CONFIRMED", "REFUTED", "UNEXPLAINED")


class CardImmutableError(ValueError):
    """A card was changed after it was registered."""


def _digest(content: dict) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()


def conjecture_card(registry: ArtifactRegistry, card_id: str, tier: str, **content: str) -> str:
    """Register a card; the same content again is no change, another raises."""
    digest = _digest(content)
    if registry.exists(f"card_{card_id}", tier):
        if load_card(registry, card_id, tier)["digest"] != digest:
            raise CardImmutableError(f"card {card_id} has other content")
        return digest
    registry.register(f"card_{card_id}", {"content": content, "digest": digest}, tier)
    return digest


def load_card(registry: ArtifactRegistry, card_id: str, tier: str) -> dict:
    """The card, after checking its content against its digest."""
    card = registry.load(f"card_{card_id}", tier)
    if _digest(card["content"]) != card["digest"]:
        raise CardImmutableError(f"card {card_id} was tampered with")
    return card


def verdict(registry: ArtifactRegistry, card_id: str, tier: str, outcome: str, evidence: str) -> dict:
    """Record an outcome for a registered card."""
    if outcome not in OUTCOMES:
        raise ValueError(f"outcome must be one of {OUTCOMES}")
    card = load_card(registry, card_id, tier)
    out = {"card": card_id, "digest": card["digest"], "outcome": outcome, "evidence": evidence}
    registry.register(f"verdict_{card_id}", out, tier)
    return out
