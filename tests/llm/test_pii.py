import duckdb
import numpy as np
import pytest
from conftest import TESTDATA

pii = pytest.importorskip("corvane.llm.pii")
from corvane.llm import spots  # noqa: E402
from corvane.llm.spans import Names, label, varied  # noqa: E402

LINES = ["Best regards, Ketil Plournquist", "Call +44 7700 900609 ext. 37 before entering.", "SSN 000-87-8873", "Send it to 98 Brusk Rd, Kaldvik.", "cc x.y@post.example; z(at)post.example", "Torque @ 31 Nm, then 331 x 8449 mm plates."]


def test_labels():
    names = Names([f"Hello Ketil {s}{e}" for s in ("Plourn", "Kvist", "Vornh", "Zelt") for e in ("quist", "moen", "stad", "ovic")] * 2, {"Ketil"})
    assert {"quist", "moen", "stad", "ovic"} <= names.endings
    kinds = [{k for _, _, k in label(line, names)} for line in LINES]
    assert kinds == [{"name"}, {"phone"}, {"id_number"}, {"address"}, {"email"}, set()]
    rng = np.random.default_rng(1)
    for line in LINES:
        spans = label(line, names)
        text, new = varied(line, spans, names, rng)
        assert [k for *_, k in new] == [k for *_, k in spans] and all(0 <= a < b <= len(text) for a, b, _ in new)


def test_gradients():
    g = pii.Tagger(5)
    x, n, y = pii.padded([pii.encoded("ab Kim Lee", [(3, 10, "name")]), pii.encoded("7 x", []), pii.encoded("é@b.c ok", [(0, 5, "email")])])
    _, grads = g.gradients(x, n, y)
    for k, v in grads.items():
        at = np.unravel_index(np.abs(v).argmax(), v.shape)
        old, e = g.p[k][at], 1e-2
        g.p[k][at] = old + e
        up, _ = g.gradients(x, n, y)
        g.p[k][at] = old - e
        down, _ = g.gradients(x, n, y)
        g.p[k][at] = old
        assert (up - down) / (2 * e) == pytest.approx(v[at], rel=0.02, abs=1e-3), k


def test_viterbi_is_the_best_path():
    import itertools

    g = pii.Tagger(4, seed=3)
    rng = np.random.default_rng(2)
    g.p["move"] = rng.normal(size=(pii.K, pii.K)).astype(np.float32)
    s = rng.normal(size=(1, 3, pii.K)).astype(np.float32)
    move, start = g.p["move"] + pii._MOVE, g.p["start"] + pii._START
    best = max(itertools.product(range(pii.K), repeat=3), key=lambda p: start[p[0]] + s[0, 0, p[0]] + sum(move[a, b] + s[0, i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))) + g.p["end"][p[-1]])
    assert tuple(g.viterbi(s, np.array([3]))[0]) == best


def spots_of(text):
    return {k: sorted(text[a:b] for a, b in zip(*v)) for k, v in spots.find(text).items()}


def test_spots():
    got = spots_of("Ask Ann Lee at 12 Elm Rd, Hill 7;\nmail a@b.c, or x (at) y dot z; 000-87-8873\nthanks, ann lee\nA 1\n2 B 12 3456")
    assert got["email"] == [" dot ", "(at)", "@"] and got["number"] == sorted(["000-87-8", "00-87-88", "0-87-887", "87-8873"] + ["12 3456"])
    assert {"Ask Ann", "Ann Lee", "Elm Rd", "Rd, Hill", "ann lee"} <= set(got["name"]) and "2 E" in got["address"] and "Hill 7" in got["address"]
    assert all("\n" not in x for v in got.values() for x in v) and all(not v for v in spots_of("").values())


def test_regions_hold_every_spot():
    rng = np.random.default_rng(4)
    for _ in range(60):
        text = "".join(rng.choice(list("Ab1 .,@\nÉ"), 200))
        seen = spots.find(text)
        parts = spots.regions(text, seen, 5)
        assert all(b <= c for (_, b), (c, _) in zip(parts, parts[1:])) and all("\n" not in text[a:b] for a, b in parts)
        for starts, ends in seen.values():
            assert all(any(x <= a and b <= y for x, y in parts) for a, b in zip(starts, ends))


def test_groups_are_bounded():
    sizes = [1] * 600 + [150_000, 150_000, 10**6]
    groups = list(pii._grouped(sizes))
    assert [a for a, _ in groups] == [0, *(b for _, b in groups[:-1])] and groups[-1] == (602, 603)
    assert all(b - a == 1 or (b - a) * sizes[b - 1] <= pii._GROUP_CHARS and b - a <= pii._GROUP for a, b in groups)


def test_long_lines_in_windows():
    g = pii.Tagger(8)
    short = "x" * 200
    assert g.tag_lines(["", short, "y" * 5000]) is not None
    spans = g.tag_lines(["ab " * 2000])
    assert len(spans) == 1


@pytest.fixture(scope="module")
def tagger():
    p = TESTDATA / "sf0.01"
    if not p.exists():
        pytest.skip("no test tables")
    docs = [t for (t,) in duckdb.sql(f"SELECT text FROM '{p}/documents.parquet' WHERE length(text) BETWEEN 1 AND 20000 ORDER BY doc_id").fetchall()]
    listed = {n for (n,) in duckdb.sql(f"SELECT given_name FROM '{p}/given_names.parquet'").fetchall()}
    train, held = docs[:700], docs[700:]
    samples = pii.training_set(train, listed, 10_000)
    g = pii.Tagger()
    g.fit(samples, 5)
    return g, held, Names(sorted({x for t in docs for x in t.split("\n")}), listed)


def test_held_out_accuracy(tagger):
    g, held, names = tagger
    lines = sorted({x for t in held for x in t.split("\n") if x.strip()})
    good = found = true = 0
    for spans, line in zip(g.tag_lines(lines), lines):
        a, b = {k for *_, k in spans}, {k for *_, k in label(line, names)}
        good += len(a & b)
        found += len(a)
        true += len(b)
    assert good / found > 0.93 and good / true > 0.9


def test_stretches_read_as_whole_lines(tagger):
    g, held, _ = tagger
    lines = sorted({x for t in held[:150] for x in t.split("\n")})
    some, whole = g.tag_lines(lines), g.tag_lines(lines, everything=True)
    differing = [i for i, (a, b) in enumerate(zip(some, whole)) if {k for *_, k in a} != {k for *_, k in b}]
    # the windows differ, so a lightly trained network may; fully trained, 0 of 314 lines with spans differed on sf0.1
    assert len(differing) <= 0.06 * sum(map(bool, whole))


# written by hand, not by the label rules
HAND = [
    ("Please ring Torunn Skarvmoen on +47 22 12 34 56 after noon.", {"name", "phone"}),
    ("The survey report was signed by Dr. Pernille Hjortstad.", {"name"}),
    ("Write to k.ulvrmoen@yard.example before the audit.", {"email"}),
    ("contact: signy (at) works.example", {"email"}),
    ("reach me under anna dot moen at post dot example", {"email"}),
    ("Her passport is AB1234567, please keep it safe.", {"id_number"}),
    ("Social security number 123-45-6789 was on the form.", {"id_number"}),
    ("The surveyor lives at 14 Harbour Road, Kaldvik.", {"address"}),
    ("Deliver the drawings to Strandgata 12, 5003 Bergvik.", {"address"}),
    ("thanks, ketil kvistmoen", {"name"}),
    ("Table 14 lists a removable strainer for the aft turret.", set()),
    ("Tag P-1234-56, drawing 120.44.1234, rev. 2.", set()),
    ("Brusk & Zelt Ltd. accepted lot 4314 78 79.", set()),
    ("Chapter 7 replaces an older wording on cast bronze.", set()),
    ("Grace period: 30 days. Hope for early closing is low.", set()),
]


def test_lines_labelled_by_hand(tagger):
    got = [{k for *_, k in spans} for spans in tagger[0].tag_lines([line for line, _ in HAND])]
    right = sum(len(a & b) for a, (_, b) in zip(got, HAND))
    assert right >= 0.75 * sum(len(b) for _, b in HAND) and sum(len(a - b) for a, (_, b) in zip(got, HAND)) <= 2, list(zip(HAND, got))


def test_stored_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(LINES)) for i in range(3)], "doc_id long, text string")
    names = spark.createDataFrame([("Ketil",), (None,)], "given_name string")
    first = pii.trained(docs, names, windows=60, epochs=1)
    monkeypatch.setattr(pii.Tagger, "fit", None)  # a second training would fail
    again = pii.trained(docs, names, windows=60, epochs=1)
    assert all((first.p[k] == again.p[k]).all() for k in first.p)
    with pytest.raises(TypeError):
        pii.trained(docs, names, windows=61, epochs=1)


def test_tables(spark, tagger):
    g = tagger[0]
    text = "\n".join(LINES)
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n "), (5, "plain words\n" * 3000 + LINES[2]), (1, text)], "doc_id long, text string").selectExpr("*", "1 as line_no", "'x' as pii_type")
    got = sorted(map(tuple, pii.find_pii(docs, g).collect()))
    assert (1, 3, "id_number") in got and (5, 3001, "id_number") in got and len(got) == len(set(got)) and not any(d in (2, 3, 4) for d, *_ in got)
    out = pii.redact(docs, g).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[2].text is None and by[3].text == "" and by[4].text == " \n " and "[ID_NUMBER]" in by[1].text and "000-87-8873" not in by[1].text and by[1].text.count("\n") == 5
    assert pii.find_pii(docs, None).count() == 0 and pii.redact(docs, None).count() == 6
    assert pii.find_pii(docs.where("false"), g).count() == 0


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, None), (2, "nothing here")], "doc_id long, text string")
    assert pii.trained(docs, None) is None
    assert pii.plausible("12", "phone") is False and pii.plausible("Of a Kind", "name") is False
