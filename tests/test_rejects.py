from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import rejects


def brute(raw, delim):
    """A strict character-by-character reader: the fields, or None for broken quoting."""
    out, i, n = [], 0, len(raw)
    while True:
        if i < n and raw[i] == '"':
            j, text = i + 1, []
            while True:
                if j >= n:
                    return None
                if raw[j] == '"':
                    if raw[j + 1 : j + 2] == '"':
                        text.append('"')
                        j += 2
                        continue
                    break
                text.append(raw[j])
                j += 1
            j += 1
            if j < n and raw[j] != delim:
                return None
            out.append("".join(text))
        else:
            j = raw.find(delim, i)
            j = n if j < 0 else j
            if '"' in raw[i:j]:
                return None
            out.append(raw[i:j])
        if j >= n:
            return out
        i = j + 1


piece = st.lists(st.sampled_from(['"', ",", "a", "é", "\n", ";", " "]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(piece, min_size=1, max_size=6), st.sampled_from([",", ";"]))
def test_structural_index_equals_a_strict_reader(raws, delim):
    reasons, fields = rejects.read_rows(raws, [delim] * len(raws))
    for raw, reason, got in zip(raws, reasons, fields):
        want = brute(raw, delim)
        if want is None:
            assert reason == "quoting"
        elif len(want) != 5:
            assert reason == "column_count"
        else:
            assert got == want


def test_reasons_in_order(spark):
    cases = [
        ("7,req,h,f,A ⊑ B", ",", None), (' 007 ,"a, b",h,"say ""x""",', ",", None), ("7;r;h;f;A ⊑ B", ";", None), ('x"y,r,h,f,A', ",", "quoting"), ('"7"8,r,h,f,A ⊑ B', ",", "quoting"), (' "7",r,h,f,A ⊑ B', ",", "quoting"),
        ('x,"a', ",", "quoting"), ("7,r,h,f", ",", "column_count"), ("", ",", "column_count"), (None, ",", "column_count"), ("7,r,h,f,", None, "column_count"), ("7,r,h,f,", "", "column_count"), ("1.0,r,h,f,B", ",", "invalid_id"), (",r,h,f,A ⊑ B", ",", "invalid_id"),
        ("-1,r,h,f,A ⊑ B", ",", "invalid_id"), ("9223372036854775807,r,h,f,", ",", None), ("9223372036854775808,r,h,f,", ",", "invalid_id"), ("٣,r,h,f,", ",", "invalid_id"), ("1,r,h,f,A", ",", "invalid_fprime"), ('1,"line\nbreak",h,f,A ⊑ B', ",", None),
        ("1," + "x" * 50_000 + ",h,f,A ⊑ B", ",", None),
    ]
    df = spark.createDataFrame([(i, r, d, "extra") for i, (r, d, _) in enumerate(cases)], "raw_id long, raw string, delim string, reason string")
    got = {r.raw_id: r for r in rejects.load_rows(df).collect()}
    assert len(got) == len(cases)
    for i, (_, _, reason) in enumerate(cases):
        assert got[i].reason == reason, cases[i]
    assert got[1].id == 7 and got[1].req == "a, b" and got[1].f == 'say "x"' and got[1].f_prime == ""
    assert got[3].id is None and rejects.faulty_rows(df).count() == sum(c[2] is not None for c in cases)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", ",")] * 3, "raw_id long, raw string, delim string")
    assert rejects.faulty_rows(df).count() == 3
    assert rejects.load_rows(df.where("false")).count() == 0
