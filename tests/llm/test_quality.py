import re
from collections import Counter

from assayer.llm import quality
from assayer.llm.queries import op2_quality_rules
from tests.llm.cases import ODD, PROSE, documents


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == base(docs[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_odd_rows(spark):
    texts = [*ODD, (20, "a b c a b c\n\na b c"), (21, "x\x1cy \x0b z\x85q z\x85q"), (22, "same\r\nsame\nsame"), (23, "1 2 3 " * 30 + "\U0001F600 <|> & ||")]
    rows = quality.verdicts(quality.clean(documents(spark, texts))).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((d, *base(t)) for d, t in texts)
    assert quality.clean(documents(spark, [])).count() == 0


def test_line_rules(spark):
    other = "Every morning some people walk along the quiet river and talk about things they saw yesterday evening there"
    good = PROSE + ".\n" + other + ".\nA short title\n" + " ".join(f"word{i}" for i in range(30)) + "."
    menu = " | ".join(f"item{i}" for i in range(60))
    noise = " ".join(f"token{i}###" for i in range(60))
    docs = documents(spark, [(1, good), (2, good + "\n" + menu[:60]), (3, good[:200] + "\n" + menu), (4, noise), (5, good + "\nWe use cookies, see our privacy policy")])
    rows = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert [rows[i].kept for i in (1, 2, 3, 4, 5)] == [True, True, False, False, True]
    assert rows[1].cleaned == good
    assert "item1" not in rows[2].cleaned and "privacy" not in rows[5].cleaned


def test_separators_that_a_line_end_follows_are_words(spark):
    """A dollar sign of the JVM also stands ahead of x85 and u2028, which are no white space here: such words are no lone separators."""
    for end in ("\x85", "\u2028", "\u2029"):
        line = " ".join(f"word{i} |{end}" for i in range(30))
        cleaned = quality.clean(documents(spark, [(1, line), (2, line.replace(end, ""))])).collect()
        assert {r.doc_id: r.cleaned for r in cleaned} == {1: line, 2: ""}, repr(end)


def test_windows_that_share_bits_are_told_by_their_words(spark, monkeypatch):
    """With one or no bit of the hash left of a place, all windows are looked at again; the counts stay."""
    texts = [*ODD, (20, "a b c a b c\n\na b c"), (21, "1 2 3 " * 30 + "x"), (22, " ".join(f"w{i % 97} v{i % 89}" for i in range(3000)))]
    for bits in (31, 62, 63):
        monkeypatch.setattr(quality, "_PLACE_BITS", bits)
        rows = quality.base_counts(documents(spark, texts)).select("doc_id", "n_repeat_words").collect()
        assert Counter(map(tuple, rows)) == Counter((d, base(t)[4]) for d, t in texts), bits


def test_only_numbers_are_sorted_for_all_windows(spark):
    plan = quality.verdicts(quality.clean(documents(spark, ODD)))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(transform(windows" in plan and "(shiftleft(xxhash64(" in plan
