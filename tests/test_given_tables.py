"""Queries over small tables in place of the given ones: each must read what is there, and all of it."""


from cloakwork.plans import catalog

TURNS = "conv_id bigint, turn bigint, role string, text string"


def run(spark, at, query, **tables):
    """The rows of a query over tables (rows, schema), sorted."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    return sorted(map(tuple, catalog.QUERIES[query](spark, str(at)).collect()), key=repr)


def test_action_matrix(spark, tmp_path):
    """no text, blocked, entities of a request, waiting for a token's end or for a realistic value, changed, none."""
    name = "Abcdefghijk"
    rows = [(1, 0, "user", "a"), (7, 0, "user", f"a, {name}"), (1, 1, "user", f"a,\n{name}"), (2, 0, "user", "a,"), (1, 3, "assistant", "a, [PERS"), (3, 1, "assistant", "a,"), (1, 2, "assistant", "a, [PERS"), (1, 4, "assistant", f"a, tion {name}"), (2, 4, "system", ","), (4, 0, None, None)]
    got = {(c, t): a for c, t, a in run(spark, tmp_path, "action_matrix", conversations=(rows, TURNS))}
    assert got == {(1, 0): "NONE", (7, 0): "BLOCKED", (1, 1): "GUARDRAIL_INTERVENED", (2, 0): "NONE", (1, 3): "WAIT", (3, 1): "WAIT", (1, 2): "NONE", (1, 4): "GUARDRAIL_INTERVENED", (2, 4): "NONE", (4, 0): "NONE"}


def test_bearer_token(spark, tmp_path):
    """the field's case, the scheme's case and blanks, other fields and schemes, texts of blanks or lines, null."""
    rows = [(0, 0, "user", "a b\nc \n"), (1, 1, "user", "x"), (3, 2, "user", "y"), (0, 3, "user", "z"), (2, 0, "user", "w"), (4, 0, "user", "v"), (5, 0, "user", "v"), (0, 1, "user", " \n"), (0, 2, "user", "[present]"), (6, 1, "user", "bearer  q"), (6, 0, "user", "bearerq"), (1, 0, "user", None)]
    got = {(c, t): a for c, t, a in run(spark, tmp_path, "bearer_token", conversations=(rows, TURNS))}
    assert {k: v for k, v in got.items() if v is not None} == {(0, 0): "a b\nc", (1, 1): "x", (3, 2): "y", (6, 1): "q"} and len(got) == len(rows)


def test_collision_resolve(spark, tmp_path):
    """calls by key; a name that is there twice is one entity, and 150 names are more than a vocabulary of 196 gives apart at first."""
    rows = [(i, f"Person {i}") for i in range(151)] + [(3, "Person 4"), (1500, ""), (1501, None), (3000, "Ann Lee")]
    assert run(spark, tmp_path, "collision_resolve", customer=(rows, "c_custkey bigint, c_name string")) == [(0, 150, 150, 0), (1, 1, 1, 0), (20, 1, 1, 0)]


def test_detector_subset(spark, tmp_path):
    """F16: known ones in their order, each once; all where none is known or none was asked for; the unknown ones."""
    rows = [(0, 1), (1, 0), (2, 5), (3, 5), (4, 4), (5, 2), (22, 0), (26, 6)]
    got = {i: (a, u) for i, a, u in run(spark, tmp_path, "detector_subset", events=(rows, "event_id bigint, user_id bigint"))}
    all_ = "regex,denylist,privacy_filter,gliner_pii,llm"
    assert got == {0: (all_, None), 1: ("regex,denylist,llm", ""), 2: (all_, "bogus,nothing,"), 3: (all_, "bogus,nothing"), 4: ("llm", "bogus,"), 5: ("privacy_filter,gliner_pii,llm", ""), 22: (all_, None), 26: ("llm", "nothing,")}


def test_bioes_decode(spark, tmp_path):
    """F8: a word's tag goes by its length: 1 and 6 begin, 2, 5 and 10 go on, 3 and 9 end, 4 stands alone, 7 is none, 8 has no tag, 13 is padding."""
    a = {n: "x" * n for n in range(1, 14)}
    texts = [
        f"{a[1]} {a[2]}  {a[3]} {a[11]}",  # begun, goes on, ended, outside
        f"{a[1]} {a[13]} {a[7]} {a[3]} {a[3]}",  # padding and an unknown mark are passed over; a stray end
        f"{a[2]} {a[5]}\n{a[9]} {a[8]} {a[4]}",  # a stray one begins; another label; its end; a null tag; alone
        f"{a[6]} {a[5]} {a[1]}",  # another label; open at the end
        None,
    ]
    got = run(spark, tmp_path, "bioes_decode", conversations=([(0, i, "user", t) for i, t in enumerate(texts)], TURNS))
    want = [(0, 0, "person", 0, 9, "x xx  xxx"), (0, 1, "person", 0, 27, texts[1][:27]), (0, 1, "person", 28, 31, "xxx"), (0, 2, "person", 0, 2, "xx"), (0, 2, "place", 3, 18, texts[2][3:18]), (0, 2, "place", 28, 32, "xxxx"), (0, 3, "place", 0, 12, texts[3][:12]), (0, 3, "person", 13, 14, "x")]
    assert got == sorted(want, key=repr)


def test_tags_worked_out_by_hand(spark):
    from cloakwork.operators import detect as D

    tagged = [
        (1, "Hi Alice Smith x", [("O", 0, 2), ("B-person", 2, 8), ("E-person", 8, 14), ("O", 14, 16)]),
        (2, "Bob and Eve", [("S-person", 0, 3), ("O", 3, 7), ("B-person", 7, 11)]),
        (3, "a b c d", [("I-x", 0, 1), ("I-x", 2, 3), ("I-y", 4, 5), ("E-x", 6, 7)]),
        (4, "pq rs", [("B-a", 0, 2), ("B-a", 3, 5)]),
        (5, "zz yy", [("O", 0, 0), ("B-a", 0, 2), ("O", 0, 0), ("E-a", 3, 5)]),
        (6, "only", [("O", 0, 4)]),
    ]
    rows = spark.createDataFrame(tagged, "id int, text string, tokens array<struct<tag:string,start:int,end:int>>")
    got = {r.id: [tuple(s) for s in r.s] for r in rows.select("id", D.decode_tags(rows.text, rows.tokens).alias("s")).collect()}
    assert got == {1: [("person", 3, 14, "Alice Smith")], 2: [("person", 0, 3, "Bob"), ("person", 8, 11, "Eve")], 3: [("x", 0, 3, "a b"), ("y", 4, 5, "c"), ("x", 6, 7, "d")], 4: [("a", 0, 2, "pq"), ("a", 3, 5, "rs")], 5: [("a", 0, 5, "zz yy")], 6: []}


def test_conversation_source(spark, tmp_path):
    """a conversation for each given one, as long as its lines; beyond 30 the templates start over; no lines, no conversation."""
    rows = [(1, 0, "user", "a\nb"), (1, 1, "assistant", "\n"), (2, 0, "user", "x\n" * 42), (3, 0, "user", None), (4, 0, "user", "")]
    got = run(spark, tmp_path, "conversation_source", conversations=(rows, TURNS))
    want = {1: (4, 4, 0), 2: (43, 30, 13), 4: (1, 1, 0)}
    assert got == sorted((f"{s}-{c}", *v) for s in ("support", "hr", "tech") for c, v in want.items())


def test_bench_matrix(spark, tmp_path):
    """every cell is there, with its runs; runs of no cell aren't counted."""
    rows = [(5, 0, "view", 1.0), (5, 4, "view", 4.0), (5, 0, "error", 9.0), (6, 3, "click", 2.5), (0, 1, "view", 7.0)]
    got = run(spark, tmp_path, "bench_matrix", events=(rows, "event_id bigint, user_id bigint, event_type string, value double"))
    assert len(got) == len({r[:4] for r in got}) == 70
    assert [r for r in got if r[4]] == [("gliner_pii", "varied", "detector", "redis", 1, 2.5), ("regex", "none", "detector", "memory", 2, 2.5)] and all(r[5] is None for r in got if not r[4])


def test_dedup_sources(spark, tmp_path):
    """order, type and sources of the first place; empty texts are dropped; nothing for null or no words."""
    rows = [(1, 0, "user", "aa bb c aa bb aa aa"), (1, 1, "user", "- 12"), (2, 0, "user", None), (2, 1, "user", "é zz")]
    got = run(spark, tmp_path, "dedup_sources", conversations=(rows, TURNS))
    assert got == [(1, 0, 0, "aa", "PERSON", "regex,denylist"), (1, 0, 1, "bb", "URL", "llm"), (2, 1, 0, "zz", "PERSON", "regex")]


def test_denylist_boundary(spark, tmp_path):
    """letters beyond ASCII and underscores are parts of words; of entries at a place the longest counts."""
    rows = [(1, 0, "user", "The Ree of thee, of the"), (1, 1, "user", "deà de la éde de_ de lan."), (2, 0, "user", None), (2, 1, "user", "Re")]
    got = run(spark, tmp_path, "denylist_boundary", conversations=(rows, TURNS))
    assert got == sorted([(1, 0, 0, 3, "The", "PERSON"), (1, 0, 8, 10, "of", "ORGANIZATION"), (1, 0, 17, 23, "of the", "ORGANIZATION"), (1, 1, 4, 9, "de la", "OTHER"), (1, 1, 18, 20, "de", "OTHER"), (2, 1, 0, 2, "Re", "PERSON")], key=repr)


def test_names_and_longer_names(spark):
    from cloakwork.operators import detect as D
    from cloakwork.sources.rules import Literal

    named = [(1, "Inesita wrote to Tomasz"), (2, "Ines, Ines's notes; and (Ines)"), (3, "She left Quarry Works last May"), (4, "Ines or Tomas"), (5, "the plan for Blue Heron stands")]
    people = [Literal("PERSON", "Ines"), Literal("PERSON", "Tomas"), Literal("ORGANIZATION", "Quarry"), Literal("ORGANIZATION", "Quarry Works"), Literal("OTHER", "Blue Heron")]
    got = {r.i: [(c.start, c.value) for c in r.candidates] for r in D.denylist(spark.createDataFrame(named, "i int, text string"), people).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {1: [], 2: [(0, "Ines"), (6, "Ines"), (25, "Ines")], 3: [(9, "Quarry Works")], 4: [(0, "Ines"), (8, "Tomas")], 5: [(13, "Blue Heron")]}


DOCUMENTS = ([(1, "thnd the x wh ntly a@b.org thnd ab 10.0.0.1 300.1.1.1"), (2, "Abcdefghijklmno thnd the"), (3, "nothing"), (4, None), (5, "c@d.org")], "doc_id bigint, text string")


def test_corpus_cases(spark, tmp_path):
    """documents that expect something are cases; a name and a number that is no address stay."""
    assert run(spark, tmp_path, "corpus_cases", documents=DOCUMENTS) == [("1", 5, 4, 4, 3, 4, 2, 1), ("2", 2, 1, 1, 1, 1, 1, 0), ("5", 1, 1, 1, 1, 1, 0, 0)]


def test_cases_worked_out_by_hand(spark):
    from cloakwork.operators import quality as Q
    from cloakwork.plans.scores import outputs
    from cloakwork.sources.rules import Literal, load_pack
    from cloakwork.sources.synthetic import CASES

    labelled = [
        ("creds", "host dc01.corp at 10.0.7.42, hash 8846f7eaee8fb117ad06bdd830b7586c", [("dc01.corp", "HOSTNAME", False), ("10.0.7.42", "IPV4_ADDRESS", False), ("8846f7eaee8fb117ad06bdd830b7586c", "HASH", False)], [], []),
        ("mail", "Write to ann@example.com, please.", [("ann@example.com", "EMAIL_ADDRESS", False)], ["please"], []),
        ("people", "Ann Lee lives in Milton.", [("Ann Lee", "PERSON", True), ("Milton", "ADDRESS", True)], [], []),
        ("name", "Project Zephyr starts.", [("Project Zephyr", "ORGANIZATION", False)], ["starts"], ["denylist"]),
        ("plain", "What is the capital of France?", [], ["capital of France"], []),
        ("card", "card 4111-1111-1111-1111 and 4111-1111-1111-1112", [("4111-1111-1111-1111", "CREDIT_CARD", False), ("4111-1111-1111-1112", "CREDIT_CARD", False)], [], []),
    ]
    done = outputs(spark.createDataFrame(labelled, CASES), ["regex", "denylist"], load_pack(), [Literal("ORGANIZATION", "Project Zephyr"), Literal("PERSON", "starts")])
    want = [("creds", 3, 3, 3, 3, 3, 0, 0), ("mail", 1, 1, 1, 1, 1, 1, 1), ("people", 2, 0, 0, 0, 0, 0, 0), ("name", 1, 1, 1, 1, 1, 1, 0), ("plain", 0, 0, 0, 0, 0, 1, 1), ("card", 2, 2, 2, 2, 1, 0, 0)]
    assert sorted(map(tuple, Q.score_cases(done).collect())) == sorted(want)


def test_corpus_scores(spark, tmp_path):
    """the sums of the three cases that the documents make."""
    assert run(spark, tmp_path, "corpus_scores", documents=DOCUMENTS) == [(0.75, 0.833333, 0.75, 0.333333)]


def test_detector_compare(spark, tmp_path):
    """rules alone don't have the case that needs the denylist."""
    got = run(spark, tmp_path, "detector_compare", documents=DOCUMENTS)
    assert got == [("all", 0.75, 0.833333, 0.75, 0.333333), ("denylist", 0.375, 0.333333, 0.375, 0.333333), ("regex", 0.333333, 0.5, 0.333333, 1.0)]
