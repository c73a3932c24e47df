"""Plan preparation against a plain sequential version, on random plans."""

import random

import pytest

from newsloom.operators import planning

FACT = "facts array<struct<claim:string,supporting_item_ids:array<bigint>>>"
EVENTS = f"plan string, position int, event_key string, item_ids array<bigint>, title string, publishability string, history_status string, prior_event_key string, {FACT}, caveats array<string>, split_reason string, event_family_key string"
RANK = {"candidate": 0, "needs_review": 1, "rejected": 2}


def _plain(events, items, history, index, fill=False, searched=None):
    """One plan, event by event. items: {id: (active, identities)}."""
    errors, keys, owner, done = [], set(), {}, []
    for e in events:
        key = (e["event_key"] or "").strip()
        if not key:
            errors.append(("event_key_missing", str(e["position"])))
            continue
        if key in keys:
            errors.append(("event_key_twice", key))
            continue
        keys.add(key)
        ids = list(dict.fromkeys(i for i in e["item_ids"] or [] if i is not None and i > 0))[:40]
        if not ids:
            errors.append(("items_missing", key))
            continue
        if outside := [i for i in ids if i not in items]:
            errors.append(("items_outside", ",".join(map(str, outside))))
            continue
        taken = None
        for i in ids:
            if i in owner:
                taken = (i, owner[i])
                break
            owner[i] = key
        if taken:
            errors.append(("item_taken", f"{taken[0]}:{taken[1]}"))
            continue
        exact = [h for i in ids for k in items[i][1] for h in index.get(k, [])]
        asked, wanted, flags = (e["prior_event_key"] or "").strip() or None, (e["history_status"] or "uncertain").lower(), []
        if asked and asked not in history:
            prior, status, flag = None, "uncertain", "prior_event_outside_history_window"
        else:
            prior, flag = asked or (exact[0] if exact else None), None
            if prior:
                status = "meaningful_update" if wanted == "meaningful_update" and e["facts"] else "repeat"
            elif wanted in ("repeat", "meaningful_update"):
                status, flag = "uncertain", "history_match_not_found"
            elif wanted in ("new", "uncertain"):
                status = wanted
            else:
                status, flag = "uncertain", "invalid_novelty_status"
        facts, wrong = [], None
        for claim, support in e["facts"] or []:
            own = list(dict.fromkeys(i for i in support or [] if i is not None and i > 0))
            wrong = "fact_without_claim" if not (claim or "").strip() else "fact_of_others" if any(i not in ids for i in own) else "fact_without_support" if not own else None
            if wrong:
                break
            facts.append((claim.strip(), own))
        if wrong:
            errors.append(("fact", f"{key}:{wrong}"))
            continue
        pub = (e["publishability"] or "candidate").lower()
        if pub not in RANK:
            pub = "needs_review"
            flags.append("invalid_publishability")
        if status == "repeat":
            pub = "rejected"
            flags.append("confirmed_repeat_without_material_change")
        elif pub == "candidate" and not facts:
            pub = "needs_review"
            flags.append("candidate_without_facts")
        elif pub == "needs_review":
            flags.append("uncertain_event_core")
        caveats = list(dict.fromkeys([c.strip() for c in e["caveats"] or [] if c and c.strip()] + ([flag] if flag else []) + flags))
        done.append({"position": e["position"], "event_key": key, "item_ids": ids, "publishability": pub, "history_status": status, "prior_event_key": prior, "facts": facts, "caveats": caveats, "family": e["event_family_key"] or key, "split_reason": e["split_reason"]})
    while True:
        pair, seen = None, {}
        for j, e in enumerate(done):
            ks = {k for i in e["item_ids"] for k in items[i][1]} if e["publishability"] != "rejected" else set()
            met = [seen[k] for k in ks if k in seen]
            if met:
                pair = (min(met), j)
                break
            seen |= dict.fromkeys(ks, j)
        if pair is None:
            break
        a, b = done[pair[0]], done[pair[1]]
        order = lambda e: (RANK[e["publishability"]], -len(e["item_ids"]), e["event_key"])
        lead, other = (a, b) if order(a) <= order(b) else (b, a)
        new = dict(lead, position=a["position"])
        for c in ("item_ids", "facts", "caveats"):
            new[c] = lead[c] + [x for x in other[c] if x not in lead[c]]
        note = f"merged exact-identity event {other['event_key']} into {lead['event_key']}"
        new["caveats"] = new["caveats"] + ([note] if note not in new["caveats"] else [])
        done = [*done[: pair[0]], new, *done[pair[0] + 1 : pair[1]], *done[pair[1] + 1 :]]
    missing = sorted(i for i, (active, _) in items.items() if active and not any(i in e["item_ids"] for e in done))
    if fill:
        return done, missing
    if missing:
        errors.append(("not_covered", ",".join(map(str, missing))))
    if searched is not None:
        errors += [("search_required", e["event_key"]) for e in done if e["publishability"] == "needs_review" and e["event_key"] not in searched]
    return done, errors


def _random(seed, n=25):
    rng = random.Random(seed)
    items = {i: (rng.random() < 0.5, [f"i{rng.randrange(14)}" for _ in range(rng.choice([0, 1, 1, 2]))]) for i in range(1, 70)}
    events = []
    for p in range(n):
        ids = [p * 2 + 1, p * 2 + 2][: rng.choice([1, 2, 2])] + [rng.choice([rng.randrange(1, 70), p * 2 + 3, -3, None]) for _ in range(rng.choice([0, 0, 1, 2]))] if rng.random() < 0.95 else None
        if rng.random() < 0.04:
            ids = [*(ids or []), 999]
        facts = [(rng.choice(["c1", "c2 ", "c3", "c4", "c5", ""]) if rng.random() < 0.2 else "c", [i for i in ids or [] if i]) for _ in range(rng.randrange(0, 3))]
        events.append({
            "position": p, "event_key": rng.choice([*[f"e{p}"] * 8, f" e{p}", f"e{rng.randrange(n)}", "", None]), "item_ids": ids, "title": rng.choice([None, "t"]), "publishability": rng.choice(["candidate", "Candidate", "needs_review", "rejected", "odd", None]),
            "history_status": rng.choice(["new", "new", "new", "uncertain", "repeat", "meaningful_update", "odd", None]), "prior_event_key": rng.choice([None, None, None, None, "", "h1", "zz"]), "facts": facts, "caveats": rng.choice([None, ["x", " x", "y"], ["z"]]), "split_reason": None, "event_family_key": f"f{p}",
        })
    return events, items, {"h1", "h2"}, {"i3": ["h2", "h1"], "i5": ["h1"]}


@pytest.fixture(scope="module")
def plans(spark):
    made = {f"p{s}": _random(s) for s in range(12)}
    events = spark.createDataFrame([(p, e["position"], e["event_key"], e["item_ids"], e["title"], e["publishability"], e["history_status"], e["prior_event_key"], e["facts"], e["caveats"], e["split_reason"], e["event_family_key"]) for p, (es, *_) in made.items() for e in es], EVENTS).repartition(5)
    admissions = spark.createDataFrame([(p, i, a, ks) for p, (_, items, *_) in made.items() for i, (a, ks) in items.items()], "plan string, item_id bigint, active boolean, identities array<string>")
    history = spark.createDataFrame([(p, h) for p, m in made.items() for h in m[2]], "plan string, event_key string")
    index = spark.createDataFrame([(p, k, v) for p, m in made.items() for k, v in m[3].items()], "plan string, identity string, event_keys array<string>")
    return made, events, admissions, history, index


def test_equals_the_sequential_version(spark, plans):
    made, events, admissions, history, index = plans
    searched = spark.createDataFrame([(p, f"e{i}") for p in made for i in range(0, 25, 2)], "plan string, event_key string")
    out, errors = planning.prepared(events, admissions, history, index, searched)
    got, wrong = out.collect(), errors.filter("error <> 'family_split'").collect()
    merges = 0
    for p, (es, items, known, ix) in made.items():
        want, bad = _plain(es, items, known, ix, searched={f"e{i}" for i in range(0, 25, 2)})
        mine = sorted((r for r in got if r.plan == p), key=lambda r: r.position)
        assert [(r.position, r.event_key, list(r.item_ids), r.publishability, r.history_status, r.prior_event_key, [(f.claim, list(f.supporting_item_ids)) for f in r.facts], list(r.caveats)) for r in mine] == [(e["position"], e["event_key"], e["item_ids"], e["publishability"], e["history_status"], e["prior_event_key"], e["facts"], e["caveats"]) for e in want]
        assert sorted((r.error, r.what) for r in wrong if r.plan == p) == sorted(bad)
        merges += sum(c.startswith("merged") for e in want for c in e["caveats"])
    assert merges > 20  # the case is there


def test_fill_covers_every_active_item(plans):
    made, events, admissions, history, index = plans
    out, errors = planning.prepared(events, admissions, history, index, fill=True)
    assert errors.isEmpty()
    got = out.filter("event_key like 'unresolved-%'").collect()
    for p, m in made.items():
        assert sorted(r.item_ids[0] for r in got if r.plan == p) == _plain(*m, fill=True)[1]
    assert all(r.publishability == "needs_review" and list(r.caveats) == ["needs_review"] for r in got)


def test_families_count_within_a_plan(spark):
    rows = [("a", 0, "x", [1], "t", "candidate", "new", None, [("c", [1])], None, None, "fam"), ("a", 1, "y", [2], "t", "candidate", "new", None, [("c", [2])], None, "separate_time_window_actionable", "fam"), ("b", 0, "x", [1], "t", "candidate", "new", None, [("c", [1])], None, None, "fam")]
    items = [("a", 1, True, []), ("a", 2, True, []), ("b", 1, True, [])]
    none = spark.createDataFrame([], "plan string, event_key string, identity string, event_keys array<string>")
    _, errors = planning.prepared(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(items, "plan string, item_id bigint, active boolean, identities array<string>"), none, none)
    assert [tuple(r) for r in errors.collect()] == [("a", None, "family_split", "fam:x")]


def test_empty(spark, plans):
    _, events, admissions, history, index = plans
    out, errors = planning.prepared(events.filter("false"), admissions.filter("false"), history, index)
    assert out.isEmpty() and errors.isEmpty()
