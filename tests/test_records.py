"""Nested records against a plain walk over json.loads, with every kind of damage."""

import json
import random

from auditloom.operators import nested_json

SCHEMA = "record_id long, record_kind string, payload string, tbl string"


def _load(v):
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return v


def _list(v):
    v = _load(v)
    return [v] if isinstance(v, dict) else v if isinstance(v, list) else []


def plain(payload):
    """{(rating, step, child, place): object} by the definition."""
    try:
        o = _load(json.loads(payload))
    except ValueError:
        return {}
    if not isinstance(o, dict):
        return {}
    if "result" in o and "ratings" not in o and "step_assessments" not in o:
        o = _load(o["result"]) or {}
    out = {}
    units = [(-1, {"steps": o.get("step_assessments")})] + [(i, r) for i, r in enumerate(_list(o.get("ratings"))) if isinstance(r, dict)]
    for i, u in units:
        for j, s in enumerate(_list(u.get("steps"))):
            if isinstance(s, dict):
                for child, key in (("evidence", "evidence"), ("suggestion", "suggestions")):
                    for k, x in enumerate(_list(s.get(key))):
                        if isinstance(x, dict):
                            out[i, j, child, k] = x
    return out


def _payload(rng):
    word = lambda: rng.choice(["a", 'quo"te', "back\\slash", "tab\t", "é\U0001f600", "{not}", "[x],:", "", "\\\\", "end\\"])
    ev = lambda: rng.choice([None, {"section_id": "s1", "page": rng.choice([None, 3]), "quote": word()}, {"kind": word(), "span": {"section_id": word(), "quote": word()}}, {}])
    many = lambda f: rng.choice([None, [], f() or {}, [f() for _ in range(rng.randrange(4))], json.dumps([f(), f()])])
    step = lambda: rng.choice([None, {"step_id": word(), "evidence": many(ev), "suggestions": many(lambda: {"text": word(), "evidence": [1, {"a": [2]}]})}])
    steps = lambda: rng.choice([None, [], [step() for _ in range(rng.randrange(4))], json.dumps([step(), step()]), step() or {}])
    scored = {word(): [1, 2.5, True, {"evidence": []}], "step_assessments": steps(), "work_id": word()}
    human = {"ratings": rng.choice([{"rater_id": "r", "steps": steps()}, [rng.choice([None, {"steps": steps()}]) for _ in range(3)]]), "consensus": {"steps": [{"evidence": [{"quote": "no"}]}]}}
    o = rng.choice([scored, human, {"engine_version": "1", "result": scored}, {"result": json.dumps(scored)}, [], 5])
    text = json.dumps(o, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    return rng.choice([text, text, text, json.dumps(text), text[: rng.randrange(len(text) + 1)], text + rng.choice(["}", " ", "x", '"'])])


def test_against_a_plain_walk():
    rng = random.Random(11)
    payloads = [_payload(rng) for _ in range(1500)]
    flat = nested_json.flatten_batch(list(range(len(payloads))), [None] * len(payloads), payloads)
    got = {(r.record_id, r.rating_pos, r.step_pos, r.tbl, r.child_pos): r for r in flat.itertuples() if r.tbl in ("evidence", "suggestion")}
    want = {(i, *k): x for i, p in enumerate(payloads) for k, x in plain(p).items()}
    assert len(want) > 300 and got.keys() == want.keys()
    for k, x in want.items():
        held = x.get("span") if isinstance(x.get("span"), dict) else {}
        if k[3] == "evidence":
            assert got[k].quote == (x["quote"] if x.get("quote") is not None else held.get("quote"))
        else:
            assert got[k].text == x.get("text")


def test_every_cut_is_torn():
    text = json.dumps({"ratings": [{"steps": [{"evidence": [{"quote": 'a "b" {c}\\'}]}]}]})
    cuts = [text[:k] for k in range(len(text))]
    assert len(nested_json.flatten_batch(list(range(len(cuts))), [None] * len(cuts), cuts)) == 0
    assert len(nested_json.flatten_batch([1], [None], [text])) == 4


def test_frames(spark):
    whole = json.dumps({"work_id": "w", "step_assessments": [None, {"step_id": "S1", "evidence": {"quote": "q" * 100_000}}]})
    df = spark.createDataFrame([(1, "scored_result", whole, "x"), (1, "scored_result", whole, "x"), (2, None, None, "x"), (3, "x", "", "x"), (4, "x", "{", "x")], SCHEMA)
    flat = nested_json.flatten_reports(df)
    assert nested_json.table_of(flat, "record").count() == 2
    ev = nested_json.table_of(flat, "evidence").distinct().collect()
    assert [(r.record_id, r.rating_pos, r.step_pos, r.child_pos, len(r.quote)) for r in ev] == [(1, -1, 1, 0, 100_000)]
    assert nested_json.flatten_reports(df.limit(0)).count() == 0


def test_any_depth(spark):
    """Parts encoded into strings nine times and wrapped seven times over still come out."""
    step = {"step_id": "S1", "evidence": [{"quote": "deep"}], "suggestions": None}
    steps = [step]
    for _ in range(9):
        steps = json.dumps(steps)
    wrapped = {"step_assessments": steps}
    for _ in range(7):
        wrapped = {"result": json.dumps(wrapped)}
    rows = nested_json.flatten_reports(spark.createDataFrame([(1, "scored_result", json.dumps(json.dumps(wrapped)), "x")], SCHEMA)).collect()
    assert [(r.tbl, r.step_pos, r.child_pos, r.quote) for r in rows if r.tbl == "evidence"] == [("evidence", 0, 0, "deep")]
