import hashlib

from volpanel.llm import fingerprint as P

from llm_rows import odd_rows


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def test_all_rows_meet_their_next_document(spark, odd):
    got = P.fingerprints(odd).collect()
    rows = sorted(odd_rows(), key=key)
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in rows]
    want = []
    for i, (row, text) in enumerate(zip(rows, texts)):
        new = P.edited(text, texts[(i + 1) % len(texts)])
        want.append((row[0], len(text), hashlib.sha256(new.encode()).hexdigest(), P.of_text(text).text(), P.of_text(new).text()))
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_row_is_its_own_next(spark, none):
    assert P.fingerprints(none).count() == 0
    only = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    row = P.fingerprints(only).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_sum_of_paragraphs_in_any_order_with_insertion_and_deletion():
    a, b, c = "first paragraph of some length", "second one, a little longer than the first", "short"
    whole = P.of_text("\n".join([a, b, c]))
    assert whole.text() == P.of_text("\n".join([c, a, b])).text() == (P.of_text(a) + P.of_text(b) + P.of_text(c)).text()
    assert (whole - P.of_text(b)).text() == P.of_text("\n".join([a, c])).text()
    assert whole.text() != P.of_text("\n".join([a, b, c, ""])).text()


def test_incremental_edit_equals_a_new_fingerprint():
    text, following = "one paragraph here\n" * 5 + "the last of them, which is cut", "other words " * 10
    new = P.edited(text, following)
    assert P.of_edited(text, P.of_text(text), new).text() == P.of_text(new).text()
    assert P.of_text(text).likeness(P.of_text(new)) > P.of_text(text).likeness(P.of_text(following))


def test_extra_columns(crowded, odd):
    assert sorted(map(str, P.fingerprints(crowded).collect())) == sorted(map(str, P.fingerprints(odd).collect()))
