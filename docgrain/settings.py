"""Settings: defaults, then a file, then a profile's file, then the environment."""

from __future__ import annotations

import json
import os
from copy import deepcopy
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "chunking": {"size": 900, "overlap": 150},
    "embedding": {"dim": 384},
    "retrieval": {"top_k": 15, "graph_hops": 2, "graph_retriever": "bfs", "hybrid": True, "min_confidence": 0.10, "weak_top": 0.45, "corrective_retries": 1, "multi_hop_min_words": 10, "visual_boost": 1.05},
    "graph": {"min_community_size": 3, "prune": {"enabled": False, "min_edge_weight": 2, "min_degree": 2, "keep_typed": True, "drop_hub_percentile": 0}},
    "web": {"min_content_chars": 200, "min_relevance": 0.30, "novelty_threshold": 0.88, "max_ingest_per_query": 3},
    "guardrail": {"enabled": False, "denied_terms": []},
    "corpora": ["pdf", "web", "connected", "visual", "news"],
}


def merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; tables are merged, everything else is replaced."""
    out = deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def load(folder: str | None = None, profile: str | None = None, env: dict[str, str] | None = None) -> dict[str, Any]:
    """Settings of a folder and profile. DOCGRAIN_A__B=1 sets a.b; values are JSON where they can be."""
    out = deepcopy(DEFAULTS)
    for name in (["settings.json"] + ([f"settings.{profile}.json"] if profile else [])) if folder else []:
        path = Path(folder) / name
        if path.exists():
            out = merge(out, json.loads(path.read_text()))
    for key, raw in sorted((os.environ if env is None else env).items()):
        if key.startswith("DOCGRAIN_"):
            try:
                value = json.loads(raw)
            except ValueError:
                value = raw
            for part in reversed(key.removeprefix("DOCGRAIN_").lower().split("__")):
                value = {part: value}
            out = merge(out, value)
    return out
