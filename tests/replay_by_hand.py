"""Row-by-row replay in plain Python, for comparison with the engine. Missing values are None."""

from __future__ import annotations


def shrink(remaining, by):
    return None if remaining is None or by is None else max(remaining - by, 0.0)


def run_s(rows):
    """``rows``: dicts of one file in (ts, line_no) order."""
    rows = sorted(rows, key=lambda r: (r["ts"], r["line_no"]))
    at = {}
    for r in rows:
        at.setdefault((r["order_id"], r["ts"]), []).append(r)
    noop, reprice = set(), set()
    for key, group in at.items():
        adds = [r for r in group if r["raw_type"] == "ADD"]
        if adds and any(r["raw_type"] == "DELETE" and r["size"] == 0 for r in group):
            noop.add(key)
        for s in group:
            if s["raw_type"] == "SUB" and s["size"] is not None:
                if any(a["size"] is not None and abs(a["size"] - s["size"]) <= 1e-9 for a in adds):
                    reprice.add(key)
    out, book, session, in_snapshot = [], {}, 0, False

    def emit(r, kind, seq, size, remaining, reason, price="row"):
        out.append(
            (r["order_id"], session, r["symbol"], r["side"], kind, seq, r["ts"],
             r["price"] if price == "row" else price, size, remaining, reason)
        )

    for r in rows:
        oid, kind, key = r["order_id"], r["raw_type"], (r["order_id"], r["ts"])
        if key in noop and kind in ("DELETE", "ADD"):
            continue
        if kind not in ("ADD", "SUB", "MATCH", "SET", "DELETE", "SNAPSHOT"):
            continue
        if kind == "SNAPSHOT":
            if not in_snapshot:
                reset(out, book, session, r)
                book.clear()
                session += 1
            in_snapshot = True
        else:
            in_snapshot = False
        state = book.get(oid)
        if kind == "SNAPSHOT" or (kind == "ADD" and not (key in reprice and state)):
            book[oid] = {"rem": r["size"], "price": r["price"], "side": r["side"], "seq": 0}
            emit(r, "ADD", 0, r["size"], r["size"], None)
            continue
        if kind == "SUB" and key in reprice or state is None:
            continue
        if kind == "ADD":
            state.update(rem=r["size"], price=r["price"], seq=state["seq"] + 1)
            emit(r, "MODIFY", state["seq"], r["size"], r["size"], "PRICE_CHANGE")
        elif kind in ("SUB", "MATCH"):
            state["rem"] = shrink(state["rem"], r["size"])
            state["seq"] += 1
            full = state["rem"] is not None and state["rem"] <= 0
            reason = ("FULL_FILL" if full else "PARTIAL_FILL") + ("_TRADE" if kind == "MATCH" else "")
            emit(r, "FILL", state["seq"], r["size"], state["rem"], reason)
        elif kind == "SET":
            if r["new_size"] is not None:
                state.update(rem=r["new_size"], seq=state["seq"] + 1)
                emit(r, "MODIFY", state["seq"], state["rem"], state["rem"], "SIZE_CHANGE")
            if r["new_price"] is not None:
                state.update(price=r["new_price"], seq=state["seq"] + 1)
                emit(r, "MODIFY", state["seq"], state["rem"], state["rem"], "PRICE_CHANGE", r["new_price"])
        elif r["size"] != 0:
            left = shrink(state["rem"], r["size"])
            state["seq"] += 1
            if left is not None and left > 0:
                state["rem"] = left
                emit(r, "MODIFY", state["seq"], r["size"], left, "PARTIAL_DELETE")
            else:
                emit(r, "CANCEL", state["seq"], r["size"], 0.0, "CANCELLED")
                del book[oid]
    return out, len(book)


def run_q(rows):
    """``rows``: dicts of one file."""
    rows = sorted(rows, key=lambda r: (r["ts"], r["line_no"]))
    groups = {}
    for r in rows:
        groups.setdefault(r["sequence"] or 0, []).append(r)
    out, book, session = [], {}, 0

    def emit(r, kind, seq, size, remaining, reason):
        out.append((r["order_id"], session, r["symbol"], r["side"], kind, seq, r["ts"], r["price"], size, remaining, reason))

    for group in groups.values():
        kinds = {r["raw_type"] for r in group}
        fill, trade = "F" in kinds, "F" in kinds and "T" in kinds
        for r in group:
            oid, kind = r["order_id"], r["raw_type"]
            state = book.get(oid)
            if kind == "R":
                reset(out, book, session, r)
                book.clear()
                session += 1
            elif kind == "A" or (kind == "M" and state is None):
                book[oid] = {"rem": r["size"], "price": r["price"], "side": r["side"], "seq": 0}
                emit(r, "ADD", 0, r["size"], r["size"], None)
            elif kind == "M":
                sized = r["size"] is not None and r["size"] != state["rem"]
                priced = r["price"] is not None and r["price"] != state["price"]
                if sized:
                    state.update(rem=r["size"], seq=state["seq"] + 1)
                    emit(r, "MODIFY", state["seq"], r["size"], r["size"], "SIZE_CHANGE")
                if priced:
                    state.update(price=r["price"], seq=state["seq"] + 1)
                    emit(r, "MODIFY", state["seq"], state["rem"], state["rem"], "PRICE_CHANGE")
            elif kind == "C" and state is not None:
                left = state["rem"] = shrink(state["rem"], r["size"])
                state["seq"] += 1
                empty = left is not None and left <= 0
                if fill:
                    reason = ("FULL_FILL" if empty else "PARTIAL_FILL") + ("_TRADE" if trade else "")
                    emit(r, "FILL", state["seq"], r["size"], left, reason)
                elif empty:
                    emit(r, "CANCEL", state["seq"], r["size"], 0.0, "CANCELLED")
                else:
                    emit(r, "MODIFY", state["seq"], r["size"], left, "PARTIAL_DELETE")
                if empty:
                    del book[oid]
    return out, len(book)


def reset(out, book, session, r):
    for oid, s in book.items():
        out.append(
            (oid, session, r["symbol"], s["side"], "CANCEL", s["seq"] + 1, r["ts"], s["price"], s["rem"], 0.0,
             "SNAPSHOT_RESET")
        )
