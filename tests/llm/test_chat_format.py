import random
import time

from pyspark.sql import functions as F

from cloakwork.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in {*(x for x in rows if x[0] is not None), *((f"none {i}", *x[1:]) for i, x in enumerate(rows) if x[0] is None)}:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seqs = {c: tuple((a[2:]) for a in sorted(v)) for c, v in convs.items()}
    out = []
    for s in set(seqs.values()):
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            ids = [c for c, o in seqs.items() if o == s]
            out.append((min((i for i in ids if isinstance(i, int)), default=None), len(s), len(ids)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for c in range(60):
        base = r.randrange(6)
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {base} {t}" if t < 4 or r.random() < 0.5 else f"own {c}"))
    # A third of all rows without an id: some equal, some the same as a conversation or as the first turn of one.
    rows += [(None, r.randrange(3), "user", f"of no id {i % 40}") for i in range(len(rows) // 2)] + [(None, None, None, None)] * 3 + [(None, 5, *rows[0][2:]), (94, 1, "user", "of no id 1"), (None, 0, "user", "x")]
    rows += [(None, 0, "user", "of no id"), (90, 0, None, None), (91, 0, "", ""), (92, None, "user", "x"), (92, 1, "user", "y"), rows[0], (93, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(0)).withColumn("place", F.lit(0))
    got = C.format_chats(df).collect()
    assert sorted(((g.conv_id, g.n_turns, g.copies) for g in got), key=str) == brute(rows)


def test_rendering(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = C.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(g) for g in got] == [(1, 2, 1, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<\\|im_end|><|im_end|>\n")]
    assert C.format_chats(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
    lone = spark.createDataFrame([(None, 3, "user", "hi <|x|>")] * 2, SCHEMA)
    assert [tuple(g) for g in C.format_chats(lone).collect()] == [(None, 1, 2, "<|im_start|>user\nhi <\\|x|><|im_end|>\n")]


def test_empty_table(spark):
    out = C.format_chats(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["conv_id", "n_turns", "copies", "rendered"] and out.count() == 0


def test_a_third_of_all_rows_in_one_conversation(spark):
    """A long conversation and its snapshot of all turns but the last; the others are equal to each other in threes."""
    n = 20_000
    turn = lambda i: ("user" if i % 2 == 0 else "assistant", f"turn {i}")
    df = spark.range(2 * n - 1).select(F.when(F.col("id") < n, 1).otherwise(2).cast("bigint").alias("conv_id"), (F.col("id") % n).alias("turn"))
    df = df.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "turn").alias("text"))
    rest = spark.range(n).select((10 + F.floor(F.col("id") / 4)).alias("conv_id"), (F.col("id") % 4).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("other "), F.floor(F.col("id") / 12)).alias("text"))
    began = time.perf_counter()
    out = {r.conv_id: r for r in C.format_chats(df.unionByName(rest)).collect()}
    assert time.perf_counter() - began < 60
    assert len(out) == 1 + -(-n // 12) and (out[1].n_turns, out[1].copies) == (n, 1)
    assert out[1].rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in map(turn, range(n)))


def test_conversations_over_many_blocks(spark):
    """Places and prefix hashes across blocks: a hot conversation, its snapshots, one that leaves it late, and null and negative turns."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    said = [(None if i == 0 else i - 300, "user" if i % 2 else None, f"turn {i}" if i % 7 else None) for i in range(900)]
    rows = [(1, *x) for x in said] + [(c, *x) for c, n in ((2, 899), (3, 450), (4, 1), (5, 900)) for x in said[:n]] + [(6, *x) for x in [*said[:899], (700, "user", "other")]]
    rows += [(7, 3, "user", f"same turn {i:04}") for i in range(600)] + [(10 + i, 0, "user", f"alone {i}") for i in range(100)] + [(1, *said[5])] * 500
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        deal = C.prefixes(C._turns(df, "conv_id", "turn", "role", "text")).where("conv_id = 1").orderBy("place").collect()
        got = C.format_chats(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.place for r in deal] == list(range(1, 901)) and [r.is_last for r in deal] == [False] * 899 + [True]
    assert sorted(((g.conv_id, g.n_turns, g.copies) for g in got), key=str) == brute(rows)
    text = lambda r, t: f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n"
    assert next(g.rendered for g in got if g.conv_id == 1) == "".join(text(r, t) for _, r, t in said)
