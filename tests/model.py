"""Change sets by plain loops over one id's rows, to hold the engine against.

Rows are dicts of ``value, from, to, as_of``; times are day numbers.
"""


def valid(rows):
    return [r for r in rows if r["from"] < r["to"]]


def meet(a, b):
    return a["from"] < b["to"] and a["to"] > b["from"]


def touch(a, b):
    return a["to"] == b["from"] or b["to"] == a["from"]


def order(r):
    return (r["from"], r["to"], r["value"])


def merged(rows):
    """Distinct rows by range and value, then runs end to end with one value."""
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: (order(r), r["as_of"])):
        if order(r) not in seen:
            seen.add(order(r))
            if out and out[-1]["to"] == r["from"] and out[-1]["value"] == r["value"]:
                out[-1] = out[-1] | {"to": r["to"]}
            else:
                out.append(dict(r))
    return out


def delta(current, updates):
    current = valid(current)
    left = [u for u in valid(updates) if not any(meet(c, u) and c["value"] == u["value"] for c in current)]
    inter = [u for u in left if any(meet(c, u) for c in current)]
    adj = [u for u in left if u not in inter and any(touch(c, u) and c["value"] == u["value"] for c in current)]
    alone = [u for u in left if u not in inter]
    hit = [c for c in current if any(meet(c, u) for u in left) or any(touch(c, u) and c["value"] == u["value"] for u in alone)]
    line, made = inter + adj, [u for u in alone if u not in adj]
    first = min(line, key=order)["as_of"] if line else None
    points = sorted({p for r in line + hit for p in (r["from"], r["to"])})
    last = None
    for a, b in zip(points, points[1:]):
        on = [u for u in line if u["from"] <= a and u["to"] >= b]
        under = [c for c in hit if c["from"] <= a and c["to"] >= b]
        winner = min(on or under, key=order, default=None)
        if winner is None:
            continue
        if winner is last and made[-1]["to"] == a:  # one row's neighbouring segments are one
            made[-1] = made[-1] | {"to": b}
        else:
            made.append(winner | {"from": a, "to": b} | ({} if on else {"as_of": first}))
        last = winner
    return hit, merged(made)


def match(update, current):
    """(how, row): of the current rows with the update's value the one of its very range, else the last that touches it, else the first."""
    same = sorted((c for c in current if c["value"] == update["value"]), key=order)
    kinds = (
        ("exact", [c for c in same if (c["from"], c["to"]) == (update["from"], update["to"])][:1]),
        ("beside", [c for c in same if touch(c, update)][-1:]),
        ("other", same[:1]),
    )
    return next(((how, found[0]) for how, found in kinds if found), ("none", None))


def case(update, current):
    """The case of an update and the row that it is about: what is to be done with them stands in CASES."""
    how, c = match(update, current)
    if how == "beside":
        return ("1a" if c["to"] < OPEN <= update["to"] else "1b"), c
    if how == "other":
        inside = c["from"] <= update["from"] and c["to"] >= update["to"]
        return ("3a" if inside else "3b" if c["from"] == update["from"] else "3c"), c
    return {"exact": "2", "none": "4"}[how], c


#: For each case what expires (nothing, the row, or all rows of the id if nothing was inserted before) and what is inserted.
CASES = {
    "1a": ("", "update"), "1b": ("row", "merged"), "2": ("", ""), "3a": ("", ""), "3b": ("row", "update"), "3c": ("", "update"), "4": ("all", "update"),
}


def full_state(current, updates, day, stamp):
    if not updates:
        gone = [c for c in current if c["from"] < day]
        return gone, merged([c | {"to": day, "as_of": stamp} for c in gone])
    cases = [(u, *case(u, current)) for u in sorted(updates, key=order)]
    plain = [k for _, k, _ in cases if CASES[k][1] == "update"]
    gone = [c for _, k, c in cases if CASES[k][0] == "row"] + (current if plain[:1] == ["4"] else [])
    made = [u for u, k, _ in cases if CASES[k][1] == "update"]
    made += [u | {"from": min(u["from"], c["from"]), "to": max(u["to"], c["to"]), "as_of": stamp} for u, k, c in cases if CASES[k][1] == "merged"]
    ends = {u["from"]: u["to"] for u in sorted(updates, key=order)}
    gone = list({order(c): c for c in gone}.values())
    return [c | {"to": ends.get(c["from"], c["to"])} for c in gone], merged(made)


#: Days from here on count as open-ended (1970-01-01 and 2260-12-31 are days 0 and 106284).
OPEN = 84006
END = 106284
