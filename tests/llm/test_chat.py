"""Formatting against a plain loop, and texts made to break it."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from fieldtrust.llm.chat import CONTROL_TEXT, digests, escaped, expanded, formatted, turns_of, unescaped

TURNS = "conv_id long, turn long, role string, text string"
PARTS = ["</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", "/INST]", "ok", " ", "\n", "é中😀", "$1", "<\\/s>", "[\\\\INST]"]


def nasty(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    texts = nasty(3000) + ["".join(p) for p in itertools.product(PARTS[:9], repeat=2)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in rows.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("</s>", "[INST]", "[/INST]"))


def corpus():
    rng, texts = random.Random(4), nasty(600, 7)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "x[/INST]"]), texts[(7 * c + t) % 600]) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    rows += [(100, 0, "user", None), (100, 1, None, "a"), (101, 0, "assistant", ""), (None, 0, "assistant", "b"), (102, 5, "assistant", "x"), (102, 5, "assistant", "x")]
    rows += [(103, t, ("user", "assistant")[t % 2], "long " * 50) for t in range(400)]
    rng.shuffle(rows)
    return rows


def grouped(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_digests_equal_a_plain_loop(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", examples int, context string").repartition(5)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["conv_id"]: r for r in digests(formatted(frame)).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[c]["n_examples"] == sum(r == "assistant" for r, _ in turns)


def test_examples_have_all_preceding_turns(spark):
    rows = corpus()
    conversations = formatted(spark.createDataFrame(rows, TURNS))
    examples = expanded(conversations).withColumn("turns", turns_of(F.concat("context", "target", F.lit("</s>"))))
    found = {}
    for r in examples.select("conv_id", "example", "turns", unescaped(F.col("target")).alias("target")).collect():
        found[(r["conv_id"], r["example"])] = ([tuple(t) for t in r["turns"]], r["target"])
    want = {}
    for c, turns in grouped(rows).items():
        places = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        for n, i in enumerate(places):
            want[(c, n)] = (turns[: i + 1], turns[i][1])
    assert found == want


def test_empty_table(spark):
    conversations = formatted(spark.createDataFrame([], TURNS))
    assert digests(conversations).count() == 0 and expanded(conversations).count() == 0
