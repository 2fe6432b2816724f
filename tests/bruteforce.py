"""Plain-Python reference of the call-context policy, for tests only.

It walks every resource's ops in ``(ts, src, seq)`` order with one state
entry, exactly as the protocol's state owner does, and is used to check the
distributed ``resolve_contexts`` on small inputs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from datetime import timedelta


def generated(rid: str, seq: int) -> str:
    h = hashlib.md5(f"{rid}|{seq}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def fold(ops, ttl: timedelta = timedelta(hours=6)):
    """ops: iterable of (rid, ts, src, seq, k, ctx) -> {(rid, src, seq): (ctx, written)}."""
    by_rid = defaultdict(list)
    for op in ops:
        by_rid[op[0]].append(op)
    out = {}
    for rid, rows in by_rid.items():
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        cur, w = None, None
        for _, ts, src, seq, k, ctx in rows:
            live = w is not None and ts < w + ttl
            written = False
            if k == "put":
                cur, w, written = ctx, ts, True
                res = ctx
            elif live:
                res = cur
            elif k == "create":
                cur, w, written = generated(rid, seq), ts, True
                res = cur
            else:
                res = None
            out[(rid, src, seq)] = (res, written)
    return out
