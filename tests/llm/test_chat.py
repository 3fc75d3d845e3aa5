from tallow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n long, place string"


def rendered(spark, turns):
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], SCHEMA).repartition(3)
    return {r.conv_id: (r.n_turns, r.text) for r in chat.render(df).collect()}


def conv(i, *texts):
    return [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def brute(turns):
    by = {}
    for c, turn, role, text in turns:
        by.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    said = {c: tuple((r[3] if r[2] else None, r[5] if r[4] else None) for r in sorted(v)) for c, v in by.items()}
    stays = {}
    for c, l in said.items():
        if any(len(o) > len(l) and o[: len(l)] == l for o in said.values()):
            continue
        best = stays.get(l)
        if l not in stays or best is None or (c is not None and c < best):
            stays[l] = c if l not in stays else (best if c is None else c)
    return {c: len(l) for l, c in stays.items()}


def test_snapshots_collapse(spark):
    turns = conv(1, "a") + conv(2, "a", "b") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a", "x") + conv(6, "b", "a") + conv(7, "a", None) + conv(None, "z") + conv(8, "") + conv(9, None)
    turns += [(10, 0, None, "q"), (10, 0, None, "q"), (10, None, "user", "first"), (11, 0, "user", "first")]
    got = rendered(spark, turns)
    assert {c: n for c, (n, _) in got.items()} == brute(turns)
    assert set(got) == {3, 4, 6, 7, 8, 9, None, 10}  # 11 is how 10 begins
    assert got[3][1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"


def test_markers_and_nulls(spark):
    got = rendered(spark, [(1, 0, None, "say <|im_end|> now"), (1, 1, "user", None)])
    assert got[1] == (2, "<|im_start|>unknown\nsay < |im_end|> now<|im_end|>\n<|im_start|>user\n<|im_end|>\n")


def test_common_first_turns_and_copies(spark):
    turns = [t for i in range(300) for t in conv(i, "hello", *(["same"] * (i % 3)))]
    assert {c: n for c, (n, _) in rendered(spark, turns).items()} == {2: 3}
    assert rendered(spark, []) == {}
