"""Plain Python answers to problems 1 to 3, to hold the Spark queries against."""

from __future__ import annotations

import json
from collections import defaultdict


def p1(rows):
    out = set()
    for raw_id, body in rows:
        if not body:
            continue
        if "/*JSON-START*/" in body:
            rest = body.split("/*JSON-START*/", 1)[1]
            if "/*JSON-END*/" not in rest:
                continue
            body = rest.rpartition("/*JSON-END*/")[0]
        try:
            doc = json.loads(body.lstrip("﻿"))
        except ValueError:
            continue
        if not isinstance(doc, dict):
            continue
        puzzle = doc.get("puzzle", doc)
        notes = []
        entries = puzzle.get("entries") or []
        for key, entry in entries.items() if isinstance(entries, dict) else [(None, e) for e in entries]:
            if entry is None:
                continue
            eid = entry.get("id") or key or f"{entry.get('number', '')}-{entry.get('direction', '')}"
            out.add((raw_id, eid, "entry", 0))
            notes.append((eid, entry.get("annotation")))
        known = {eid for eid, _ in notes}
        for holder in (doc, puzzle):
            notes += [(eid, note) for eid, note in (holder.get("annotations") or {}).items() if eid in known]
        for eid, note in notes:
            note = json.loads(note) if isinstance(note, str) else note
            if not note:
                continue
            out.add((raw_id, eid, "annotation", 0))
            for field in ("blocks", "pieces"):
                items = note.get(field)
                items = items if isinstance(items, list) else [items]
                out |= {(raw_id, eid, field[:-1], n) for n, x in enumerate(items) if x is not None}
    return out


def p2(index, entries, authored, saves):
    norm = lambda x: x.strip().lower() if x and x.strip() else None
    puzzles, cells = defaultdict(list), defaultdict(list)
    for r in index:
        puzzles[norm(r["puzzle_id"])].append((r["loaded_at"], r["removed_at"]))
    for r in entries:
        cells[norm(r["puzzle_id"]), norm(r["entry_id"])].append((r["loaded_at"], r["removed_at"]))
    own = {norm(r["puzzle_id"]) for r in authored}
    out = set()

    def look(table, key, field, value, stays, t):
        if not stays:
            reason = "missing"
        elif all(a > t for a, _ in stays):
            reason = "late"
        elif all(b is not None and b <= t for a, b in stays if a <= t):
            reason = "deleted"
        else:
            return
        out.add((table, key, field, value, reason, t.strftime("%Y-%m")))

    for table, rows, key, at in (("clue_entry", entries, "clue_id", "loaded_at"), ("play_save", saves, "save_id", "received_at")):
        for r in rows:
            p = norm(r["puzzle_id"])
            if p and p not in own:
                look(table, r[key], "puzzle_id", r["puzzle_id"], puzzles.get(p), r[at])
            if table == "clue_entry":
                for field, values in (("linked_to", [r["linked_to"]]), ("group_ids", r["group_ids"] if r["group_ids"] is not None else [])):
                    for v in values:
                        if norm(v):
                            look(table, r[key], field, v, cells.get((p, norm(v))), r[at])
    return out


def p3(lines, allowances):
    kind = lambda v: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "list" if isinstance(v, list) else "object"
    series = defaultdict(lambda: defaultdict(lambda: [defaultdict(dict), defaultdict(set), set()]))  # values, kinds, records
    for r in lines:
        try:
            o = json.loads(r["body"] or "")
        except ValueError:
            continue
        values, kinds, records = series["a", r["feed"]][r["exported_at"], r["file_name"]]
        e = (o["id"], o["entry"])
        records.add(e)
        fields = {("", k): [v] for k, v in o.items() if k not in ("id", "entry", "annotation")}
        note = o.get("annotation") or {}
        fields |= {("annotation.", k): [v] for k, v in note.items() if k != "blocks"}
        blocks = note.get("blocks") or []
        fields |= {("annotation.blocks.", k): [b.get(k) for b in blocks] for b in blocks for k in b}
        for f, vs in fields.items():
            if any(v is not None for v in vs):
                values[f][e] = vs
                kinds[f] |= {kind(v) for v in vs if v is not None}
    for r in allowances:
        try:
            o = json.loads(r["body"] or "", parse_int=lambda x: ("n", x), parse_float=lambda x: ("n", x))
        except ValueError:
            continue
        values, kinds, records = series["b", r["feed"]][r["exported_at"], r["file_name"]]
        for k, v in o.items():
            if k[0] == "_" or v is None:
                continue
            kinds["", k].add(("field", kind(v)))
            for puzzle, n in v.items() if isinstance(v, dict) else [(x["puzzle"], x["count"]) for x in v]:
                records.add(puzzle)
                kinds["", k].add(("count", "number" if isinstance(n, tuple) else kind(n)))
                values["", k][puzzle] = n
    out = set()
    for files in series.values():
        order = sorted(files)
        for before, after in zip(order, order[1:]):
            (v0, k0, r0), (v1, k1, r1) = files[before], files[after]
            both = r0 & r1
            new, old = set(k1) - set(k0), set(k0) - set(k1)
            pairs = {(a, b) for a in new for b in old if a[0] == b[0] and all(v1[a].get(e) == v0[b].get(e) for e in both) and any(v1[a].get(e) is not None for e in both)}
            out |= {(after[1], "".join(a), "renamed", "".join(b)) for a, b in pairs}
            out |= {(after[1], "".join(a), "added", "") for a in new - {a for a, _ in pairs}}
            out |= {(after[1], "".join(b), "removed", "") for b in old - {b for _, b in pairs}}
            out |= {(after[1], "".join(f), "retyped", "") for f in set(k0) & set(k1) if k0[f] != k1[f]}
    return out
