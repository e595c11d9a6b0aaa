"""Policies: which action each entity type gets. Immutable values, passed to every call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACT, PSEUDONYMIZE, ALLOW = ACTIONS = ("redact", "pseudonymize", "allowlist")


@dataclass(frozen=True)
class Policy:
    name: str = "default"
    description: str = ""
    default_action: str = REDACT
    actions: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for action in (self.default_action, *self.actions.values()):
            if action not in ACTIONS:
                raise ValueError(f"unknown action {action!r}; there are {ACTIONS}")

    def action_for(self, entity_type: str) -> str:
        return self.actions.get(entity_type, self.default_action)

    def action(self, entity_type: Column) -> Column:
        """The action as a column; a literal chain, so nothing is joined or broadcast."""
        out = F.lit(self.default_action)
        for kind, action in self.actions.items():
            out = F.when(entity_type == kind, action).otherwise(out)
        return out

    @classmethod
    def from_mapping(cls, data: Mapping) -> Policy:
        """The form of a policy file: name, description, default_action, entities: {type: {action}}."""
        actions = {kind: (rule or {}).get("action", REDACT) for kind, rule in (data.get("entities") or {}).items()}
        return cls(data.get("name", "default"), data.get("description", ""), data.get("default_action", REDACT), actions)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Policy:
        import yaml

        return cls.from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


# The built-in policies.
BUILT_IN = {
    "default": Policy("default", "Redact all PII by default, pseudonymize person names", REDACT, {"PERSON": PSEUDONYMIZE}),
    "strict": Policy("strict", "Redact everything, no exceptions", REDACT),
    "permissive": Policy(
        "permissive",
        "Only redact high-risk entities (emails, credit cards, SSN)",
        ALLOW,
        dict.fromkeys(("EMAIL_ADDRESS", "CREDIT_CARD", "US_SSN", "PHONE_NUMBER", "IP_ADDRESS"), REDACT),
    ),
}


def policy_of(policy: str | Policy) -> Policy:
    if isinstance(policy, Policy):
        return policy
    if policy not in BUILT_IN:
        raise ValueError(f"unknown policy {policy!r}; there are {sorted(BUILT_IN)}")
    return BUILT_IN[policy]
