"""A governance policy as validated Python data and as small tables.

``check_policy`` collects every fault (unknown references, duplicates, bad patterns,
missing lists) so that a policy is refused whole: an operator never runs with a part of
its detectors.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakewarden.functions.spans import Pattern, rewrite

DEFAULT_CONTEXTS = ("prompt", "tool_result", "rag_ingest", "web_query")
MODES = ("local-only", "local-with-cloud-fallback", "cloud-allowed", "deny")


class PolicyError(ValueError):
    """All faults of a refused policy."""


@dataclass(frozen=True)
class Detector:
    id: str
    entity: str
    kind: str  # regex, checksum, ner or gazetteer
    patterns: tuple[Pattern, ...] = ()
    checksum: str | None = None
    strategy: str = "placeholder"
    placeholder: str = ""
    reversible: bool = False
    demask_for: tuple[str, ...] = ()
    contexts: tuple[str, ...] = DEFAULT_CONTEXTS
    literal: str | None = None
    options: dict = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Policy:
    digest: str
    effective_from: str | None
    roles: tuple[dict, ...]
    detectors: tuple[Detector, ...]
    data_classes: tuple[dict, ...]
    providers: tuple[dict, ...]
    rules: tuple[dict, ...]
    tools: tuple[dict, ...]
    collections: tuple[dict, ...]
    web: dict
    cloud_enabled: bool
    max_bytes: int

    def entity_rank(self, entity: str) -> int:
        """The highest rank among data classes that name the entity; 0 if none does."""
        return max((c["rank"] for c in self.data_classes if entity in (c.get("entities") or ())), default=0)


def _detector(raw: dict, faults: list[str]) -> Detector | None:
    masking = raw.get("masking", {})
    patterns = []
    for pattern in raw.get("patterns", ()):
        try:
            patterns.append(rewrite(pattern))
        except Exception as fault:  # noqa: BLE001  a bad pattern is a fault of the policy, whatever its kind
            faults.append(f"detector {raw['id']}: {fault}")
    if raw["type"] in ("regex", "checksum") and not patterns:
        faults.append(f"detector {raw['id']}: no usable pattern")
    if raw["type"] == "checksum" and raw.get("checksum") not in ("luhn", "iban-mod97"):
        faults.append(f"detector {raw['id']}: unknown checksum")
    if masking.get("strategy", "placeholder") not in ("placeholder", "redact", "hash"):
        faults.append(f"detector {raw['id']}: unknown strategy")
    return Detector(
        raw["id"],
        raw["entity"],
        raw["type"],
        tuple(patterns),
        raw.get("checksum"),
        masking.get("strategy", "placeholder"),
        masking.get("placeholderFormat", f"<{raw['entity']}_{{n}}>"),
        bool(masking.get("reversible", False)),
        tuple(masking.get("demaskFor", ())),
        tuple(raw.get("applyTo", DEFAULT_CONTEXTS)),
        raw.get("literal"),
        {k: raw[k] for k in ("ner", "gazetteer") if k in raw},
    )


def check_policy(raw: dict) -> list[str]:
    """Faults of a parsed policy: duplicates and references to what is not there."""
    spec, faults = raw["spec"], []
    ids = {
        "role": [r["id"] for r in spec.get("subjects", {}).get("roles", ())],
        "agent": [a["id"] for a in spec.get("subjects", {}).get("agents", ())],
        "data class": [c["id"] for c in spec.get("dataClasses", ())],
        "detector": [d["id"] for d in spec.get("piiDetectors", ())],
        "provider": [p["id"] for p in spec.get("routing", {}).get("providers", ())],
        "rule": [r["id"] for r in spec.get("routing", {}).get("rules", ())],
        "priority": [r["priority"] for r in spec.get("routing", {}).get("rules", ())],
        "tool": [t["id"] for t in spec.get("tools", {}).get("definitions", ())],
        "collection": [c["id"] for c in spec.get("rag", {}).get("collections", ())],
    }
    for name, values in ids.items():
        faults += [f"duplicate {name}: {v}" for v, n in Counter(values).items() if n > 1]

    def known(kind: str, values, where: str) -> None:
        faults.extend(f"{where}: unknown {kind} {v}" for v in values or () if v not in ids[kind])

    kinds = {p["id"]: p["type"] for p in spec.get("routing", {}).get("providers", ())}
    for c in spec.get("dataClasses", ()):
        known("role", c.get("assignWhen", {}).get("roles"), f"data class {c['id']}")
        known("collection", c.get("assignWhen", {}).get("collections"), f"data class {c['id']}")
    for d in spec.get("piiDetectors", ()):
        known("role", d.get("masking", {}).get("demaskFor"), f"detector {d['id']}")
    for r in spec.get("routing", {}).get("rules", ()):
        where, when, route = f"rule {r['id']}", r.get("when", {}), r["route"]
        known("data class", when.get("dataClasses"), where)
        known("role", when.get("roles"), where)
        known("agent", when.get("agents"), where)
        if route["mode"] not in MODES:
            faults.append(f"{where}: unknown mode")
        for key, kind in (("localProviders", "local"), ("cloudProviders", "cloud")):
            known("provider", route.get(key), where)
            faults += [f"{where}: {p} is not a {kind} provider" for p in route.get(key, ()) if kinds.get(p, kind) != kind]
    for t in spec.get("tools", {}).get("definitions", ()):
        known("role", t.get("allow", {}).get("roles"), f"tool {t['id']}")
        known("agent", t.get("allow", {}).get("agents"), f"tool {t['id']}")
    for c in spec.get("rag", {}).get("collections", ()):
        known("role", c.get("allow", {}).get("roles"), f"collection {c['id']}")
        known("data class", [c["dataClass"]] if "dataClass" in c else (), f"collection {c['id']}")
    return faults


def load_policy(raw: dict, body: bytes = b"") -> Policy:
    """A policy from its parsed form; PolicyError names every fault."""
    faults = check_policy(raw)
    spec = raw["spec"]
    detectors = tuple(_detector(d, faults) for d in spec.get("piiDetectors", ()))
    if faults:
        raise PolicyError("; ".join(faults))
    routing, allow = spec.get("routing", {}), spec.get("webSearch", {}).get("allow", {})
    rules = sorted(routing.get("rules", ()), key=lambda r: -r["priority"])
    return Policy(
        "sha256:" + hashlib.sha256(body).hexdigest(),
        raw.get("metadata", {}).get("effectiveFrom"),
        tuple({"id": r["id"], "claim": r["match"]["claim"], "any_of": list(map(str, r["match"]["anyOf"]))} for r in spec.get("subjects", {}).get("roles", ())),
        detectors,
        tuple(
            {
                "id": c["id"],
                "rank": c["rank"],
                "always": bool(c.get("assignWhen", {}).get("always", False)),
                "entities": c.get("assignWhen", {}).get("detectedEntities"),
                "roles": c.get("assignWhen", {}).get("roles"),
                "collections": c.get("assignWhen", {}).get("collections"),
            }
            for c in spec.get("dataClasses", ())
        ),
        tuple(routing.get("providers", ())),
        tuple(
            {
                "id": r["id"],
                "priority": r["priority"],
                "data_classes": r.get("when", {}).get("dataClasses"),
                "roles": r.get("when", {}).get("roles"),
                "agents": r.get("when", {}).get("agents"),
                "models": r.get("when", {}).get("models"),
                "mode": r["route"]["mode"],
                "local": list(r["route"].get("localProviders", ())),
                "cloud": list(r["route"].get("cloudProviders", ())),
                "fallback_on": list(r["route"].get("fallbackOn", ())),
            }
            for r in rules
        ),
        tuple(
            {
                "id": t["id"],
                "access": t.get("access", "read"),
                "roles": list(t.get("allow", {}).get("roles", ())),
                "agents": list(t.get("allow", {}).get("agents", ())),
                "max_rank": t.get("allow", {}).get("maxDataClassRank", 1 << 30),
                "schema": t.get("argumentsSchema", {}),
                "rate": t.get("rateLimit"),
                "confirm": bool(t.get("requireConfirmation", t.get("access") == "write" and spec.get("tools", {}).get("requireConfirmationForWrite", False))),
            }
            for t in spec.get("tools", {}).get("definitions", ())
        ),
        tuple(
            {
                "id": c["id"],
                "data_class": c.get("dataClass"),
                "roles": list(c.get("allow", {}).get("roles", ())),
                "payload_key": c.get("filter", {}).get("payloadKey"),
            }
            for c in spec.get("rag", {}).get("collections", ())
        ),
        {
            "enabled": bool(spec.get("webSearch", {}).get("enabled", False)),
            "roles": list(allow.get("roles", ())),
            "max_rank": allow.get("maxDataClassRank", 1 << 30),
            "max_results": spec.get("webSearch", {}).get("maxResults", 5),
        },
        bool(routing.get("cloudEnabled", False)),
        spec.get("defaults", {}).get("maxRequestBytes", 1 << 20),
    )


def rules_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """The routing rules, a row each: the policy file bounds its size."""
    names = ["id", "priority", "data_classes", "roles", "agents", "models", "mode"]
    lists = "array<string>"
    schema = f"id string, priority int, data_classes {lists}, roles {lists}, agents {lists}, models {lists}, mode string"
    return spark.createDataFrame([tuple(r[n] for n in names) for r in policy.rules], schema)
