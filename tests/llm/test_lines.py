import numpy as np
import pytest

from tallow.llm import lines, oracles

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, text_key long"


def docs_of():
    prose = [f"alpha beta{'xyz'[i % 3]} gamma {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} delta epsilon zeta eta theta" for i in range(40)]
    rows = []
    for i in range(40):
        own = [prose[i], f"Page {i} of 99 pages", "one two", f"user {'abcdefghij'[i % 10]} logged in at the main gate of site {'mnop'[i % 4]}" if i % 2 else "", f"only here {i * 7}x and {prose[(i * 3) % 40][::-1]}"]
        rows.append((i, "\n".join(own)))
    copy = "\n".join(["this whole text is copied", "all of its lines with it", "none of them may go"])
    rows += [(100 + i, copy) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "Page 4 of 99 pages"), (204, "w " * 60_000), (None, "Page 5 of 99 pages\nkept line of its own"), (0, rows[0][1])]
    return rows


def test_equals_sql(spark):
    rows = [(a, b, "en", "s", 1, "x", 2) for a, b in docs_of()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lines.drop_recurring(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_key", "n_lines", "n_dropped"]
    c = duckdb.connect()
    documents = df.select("doc_id", "text", "lang", "source", "n_chars").toPandas()  # noqa: F841
    want = c.sql(oracles.LINES).fetchall()
    names = [d for d in c.sql(oracles.LINES).columns]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3])
    pick = [names.index(n) for n in ("doc_id", "text", "n_lines", "n_dropped")]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted((tuple(None if r[i] != r[i] else r[i] for i in pick) for r in want), key=key)
    by = {r.doc_id: r for r in got.collect()}
    assert {r.text_key for r in by.values()} == {2}
    assert "Page" not in by[7].text and "one two" in by[7].text and by[105].n_dropped == 0 and by[200].text is None and by[203].text == ""


def test_variable_fields_are_generalised(spark):
    names = ["ann", "bob", "cid", "dee", "eve", "fay", "gus", "hal"]
    rows = [(i, f"report sent by the nightly job of {n} to main office today\nunique {i} {n * 3} line") for i, n in enumerate(names)]
    got = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all("nightly" not in r.text and "unique" in r.text for r in got.collect())


def test_empty_table(spark):
    assert lines.drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class Tree:
    """A plain log-template tree: token count, then the leading tokens, then groups of lines in the leaf."""

    def __init__(self):
        self.root = {}

    @staticmethod
    def template(line):
        for blank in "\t\r\x0b\f":
            line = line.replace(blank, " ")
        words = [w for w in line.split(" ") if w] or [""]
        return tuple("<*>" if any(c in "0123456789@" for c in w) else w for w in words)

    def groups(self, words):
        """The groups of a leaf that a line belongs to, made on the way."""
        node = self.root.setdefault(len(words), {})
        for w in words[:3]:
            node = node.setdefault(w, {})
        behind = words[3:]
        if not 5 <= len(words) <= 32:
            return [node.setdefault(("whole", behind), [])]
        half = -(-len(behind) // 2)
        return [node.setdefault((0, behind[:half]), []), node.setdefault((1, behind[half:]), [])]


def plain_tree(texts, min_docs=5, min_share=0.2):
    tree, found = Tree(), {}
    for text in sorted({t for t in texts if t}):
        own = {Tree.template(line) for line in text.split("\n")}
        longest = sorted((x for x in own if x != ("",)), key=lambda x: (len(" ".join(x)), " ".join(x).encode()), reverse=True)[:2]
        for x in own:
            if len(x) >= 3:
                for g in tree.groups(x):
                    g.append(next((o for o in longest if o != x), None))
    for text in texts:
        if not text:
            found[text] = (text, 0)
            continue
        stay = []
        for line in text.split("\n"):
            x = Tree.template(line)
            drop = False
            if len(x) >= 3:
                for g in tree.groups(x):
                    others = {o for o in g if o is not None}
                    drop |= len(others) >= min_docs and len(others) >= min_share * len(g)
            if not drop:
                stay.append(line)
        found[text] = ("\n".join(stay), len(text.split("\n")) - len(stay))
    return found


def logs(seed, n=150):
    rng = np.random.default_rng(seed)
    names, kinds = ["ann", "bob", "cid", "dee"], ["disk", "fan", "net"]
    vocab = [a + b for a in ("ba", "do", "ki", "lu", "mo") for b in ("ra", "sel", "um", "fin", "to")]
    rows = []
    for i in range(n):
        own = [" ".join(rng.choice(vocab, int(rng.integers(2, 45)))) for _ in range(int(rng.integers(0, 4)))]
        pick = rng.integers(0, 7)
        own.insert(0, [f"user {rng.choice(names)} came in", f"Page {i} of 99", f"job of {rng.choice(names)} ended well today", f"error in {rng.choice(kinds)} of rack {i}: stop", "the same line everywhere", f"a b c {rng.choice(vocab)} e", " \t "][pick])
        rows.append((i, "\n".join(own)))
    return [*rows, *rows[:9], (900, None), (901, ""), (902, "\n"), (None, rows[0][1])]


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_plain_tree(spark, seed):
    rows = logs(seed) + docs_of()
    want = plain_tree([t for _, t in rows])
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "place int, doc_id long, text string").repartition(3)
    got = {r.place: (r.text, r.n_dropped) for r in lines.drop_recurring(df).collect()}
    assert got == {i: want[t] for i, (_, t) in enumerate(rows)} and any(n for _, n in got.values())


def test_one_odd_line_changes_nothing(spark):
    names = ["ann", "bob", "cid", "dee", "eve", "fay", "gus", "hal"]
    rows = [(i, f"report sent by the nightly job of {n} to main office today\nunique {n * 3} line of its own kind {n}") for i, n in enumerate(names)]
    odd = (99, "report sent by nobody at all on days like this one here\nother words")
    got = {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame([*rows, odd], "doc_id long, text string")).collect()}
    assert all("nightly" not in got[i] for i in range(8)) and got[99] == odd[1]


def test_short_lines_have_fields_too(spark):
    rows = [(i, f"new login by {n} today\n{n} wrote about {n}{n} and then {n * 2} more") for i, n in enumerate(["ann", "bob", "cid", "dee", "eve", "fay"])]
    assert all("login" not in r.text for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_many_templates_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = logs(7) + docs_of()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "place int, doc_id long, text string")
    few = {r.place: (r.text, r.n_dropped) for r in lines.drop_recurring(df).collect()}
    monkeypatch.setattr(lines, "BROADCAST", 0)
    assert {r.place: (r.text, r.n_dropped) for r in lines.drop_recurring(df).collect()} == few


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 5, 6, "k", "g")] * 2, "doc_id long, text string, n_lines long, key long, at string, lines string")
    got = lines.drop_recurring(df)
    assert got.columns == ["doc_id", "text", "key", "at", "lines", "n_lines", "n_dropped"] and [tuple(r) for r in got.collect()] == [(1, "x", 6, "k", "g", 1, 0)] * 2
