"""Settings with defaults and floors, from a mapping such as the environment."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Seconds of a unit of durations, and defaults.
UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
SNAPSHOT_EVERY, LEAST_SNAPSHOT_EVERY = 10_000, 512
RETAIN = 1024
ELECTION_MS = (750, 1500)
STALL_S = 10.0


def duration(text: str) -> float | None:
    """Seconds of texts like 1m30s, 250ms or -1s; null if it is none."""
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?(?:ns|us|ms|s|m|h))+)", text.strip())
    if not m:
        return None
    total = sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ns|us|ms|s|m|h)", m[2]))
    return -total if m[1] == "-" else total


def peers(text: str) -> dict[int, str]:
    """id=address items by id; blank ones are passed over, others without = are errors."""
    out = {}
    for item in filter(None, (x.strip() for x in text.split(","))):
        name, cut, address = item.partition("=")
        if not cut:
            raise ValueError(f"want id=host:port, got {item!r}")
        out[int(name)] = address.strip()
    return out


@dataclass
class Config:
    """Values that are unset or malformed fall back to defaults; a negative stall
    timeout turns the watchdog off."""

    node_id: int
    raft_peers: dict[int, str] = field(default_factory=dict)
    kv_peers: dict[int, str] = field(default_factory=dict)
    run_agent: bool = False
    snapshot_every: int = SNAPSHOT_EVERY
    retain: int = RETAIN
    election_ms: tuple[int, int] = ELECTION_MS
    stall_s: float = STALL_S

    @classmethod
    def read(cls, env: Mapping[str, str]) -> Config:
        try:
            node = int(env.get("NODE_ID", ""))
        except ValueError:
            node = 0
        if node <= 0:
            raise ValueError("NODE_ID must be a positive integer")
        kv_peers = peers(env.get("KV_PEERS", ""))
        agent = env.get("RUN_AGENT", "false").lower() == "true"
        if agent and not kv_peers:
            raise ValueError("RUN_AGENT=true requires KV_PEERS")
        every = env.get("SNAPSHOT_ENTRIES", "")
        retain = env.get("SNAPSHOT_RETAIN", "")
        clock = [duration(env.get(k, "")) for k in ("RAFT_ELECTION_TIMEOUT_MIN", "RAFT_ELECTION_TIMEOUT_MAX")]
        stall = duration(env.get("RAFT_COMMIT_STALL_TIMEOUT", ""))
        return cls(
            node, peers(env.get("PEERS", "")), kv_peers, agent,
            max(LEAST_SNAPSHOT_EVERY, int(every)) if every.isdigit() and int(every) else SNAPSHOT_EVERY,
            int(retain) if re.fullmatch(r"-?\d+", retain) and int(retain) else RETAIN,
            tuple(round(1000 * c) if c and c > 0 else d for c, d in zip(clock, ELECTION_MS)),
            STALL_S if stall is None or stall == 0 else stall,
        )
