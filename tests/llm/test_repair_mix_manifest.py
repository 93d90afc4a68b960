"""Conversation repair, source mixing and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from functools import cache

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilake.llm import conversation_repair, merkle, mixing
from vigilake.llm.scratch import Scratch


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversations -----------------------------------------------------------------------------------------


@cache
def cheapest(signature, made="", inserts=3):
    """Least (cost, edits) by trying every edit at every place; ``made`` are the initials so far, shortened."""
    found = [(0, "")] if not signature and re.fullmatch(r"(s?(ua)+)?", made) else []
    goes_on = lambda c: re.fullmatch(r"s?(ua)*u?", made + c)
    short = lambda c: re.sub(r"(ua)(?:ua)+", r"\1", made + c)
    tries = [("I", 5, signature, short(c), inserts - 1) for c in "ua" if inserts and goes_on(c)]
    if signature:
        c, more = signature[0], 5 * signature[0].isupper()
        tries.append(("D", 2, signature[1:], made, inserts))
        if c != "d":
            tries += [("K", more, signature[1:], short(c.lower()), inserts)] if goes_on(c.lower()) else []
            tries += [("R", 1 + more, signature[1:], short(t), inserts) for t in "ua" if goes_on(t)]
    for edit, cost, *then in tries:
        rest = cheapest(*then)
        if rest:
            found.append((cost + rest[0], edit + rest[1]))
    return min(found, default=None)


@given(st.lists(st.text(alphabet="dsuaoSUAO", max_size=7), max_size=30))
def test_walk_of_the_trie_equals_trying_all_edits(signatures):
    for s, cost, edits in conversation_repair.walk(iter(sorted(set(signatures)))):
        assert (cost, edits) == cheapest(s)


def test_layers_are_computed_once_per_shared_prefix(monkeypatch):
    made = []
    plain = conversation_repair.next_layer
    monkeypatch.setattr(conversation_repair, "next_layer", lambda layer, c: made.append(c) or plain(layer, c))
    signatures = sorted(["sua", "suau", "suaua", "suaud", "ua", "uau"])
    list(conversation_repair.walk(iter(signatures)))
    assert len(made) == len({s[: i + 1] for s in signatures for i in range(len(s))})


def damaged(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return by


def report(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, signature = set(), ""
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0d]", text)
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += "b" if not marks else "d" if (role, text) in seen else c if marks[-1] in ".!?" else c.upper()
        seen.add((role, text))
    cost, edits = cheapest(signature.replace("b", "d"))
    made, left = [], iter(rows)
    for e in edits:
        next_role = "assistant" if made and made[-1][0][:1] == "u" else "user"
        _, role, text = (None, "", "") if e == "I" else next(left)
        if e != "D":
            made.append((role if e == "K" else next_role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return conv, gaps, signature.count("b"), signature.count("d"), sum(c.isupper() for c in signature), illegal, cost, edits, sha("\n".join(f"{r}:{t}" for r, t in made))


def conversations():
    r = random.Random(4)
    texts = ["Hello there.", "ok?", "so\n", "no end", " \t", "", None, "yes!", "é. "]
    rows = [(c, r.choice([t, t, t + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for c in [*range(60), None] for t in range(r.randrange(1, 7))]
    return rows + rows[:3] + [(-5, 0, "user", "only this goes.")]


@pytest.mark.parametrize("rows_per_part", [13, 50_000])
def test_repair_equals_brute_force(spark, rows_per_part):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "gone": F.lit(1), "signature": F.lit("d")})
    got = conversation_repair.repair_damaged(df, rows_per_part).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(report(c, r)) for c, r in damaged(rows).items())


def test_repair_of_nothing_and_of_a_conversation_over_many_parts(spark):
    schema = "conv_id long, turn long, role string, text string, gone boolean"
    assert conversation_repair.repair_damaged(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.", False) for t in range(400)] + [(2, 0, "user", "gone", True)]
    made = conversation_repair.Repair(spark.createDataFrame(rows, schema), 30)
    assert [(r.role, r.text, r.edit) for r in made.rows().orderBy("part", "nth").collect()] == [(r[2], r[3], "K") for r in rows[:-1]]
    got = {r.conv_id: r for r in made.report().collect()}
    assert (got[1].cost, got[1].gaps, got[1].illegal, got[1].audit) == (0, 0, 0, "K" * 400)
    assert got[1].repaired_sha256 == sha("\n".join(f"{r[2]}:{r[3]}" for r in rows[:-1]))
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))


# --- mixing ------------------------------------------------------------------------------------------------


def shares(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is over a source's most is shared out again among the others, until nothing is."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    got, over, live = dict.fromkeys(names, Fraction(0)), Fraction(sum(sizes.values())), set(names)
    while over and live:
        heavy, share, over = sum(weight[n] for n in live), over, Fraction(0)
        for n in list(live):
            got[n] += share * weight[n] / heavy
            if got[n] >= most * sizes[n]:
                over += got[n] - most * sizes[n]
                got[n] = Fraction(most * sizes[n])
                live.discard(n)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_sharing_by_hand(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 100, 10 ** r.randrange(7)]) for i in range([0, 1, 4, 60][seed])} | {None: 3 * seed, "": 7 * seed, "é": 2}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {row.source: row.target for row in mixing.source_targets(df, Scratch(spark, "t"), rows_per_part=7).collect()}
    assert got == pytest.approx({n: float(x) for n, x in shares(sizes).items()})


def test_mix_takes_what_it_should(spark):
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", " ".join("w" * (1 + i % 3) for _ in range(r.randrange(1, 60)))) for i in range(6000)] + [(None, None, "a b c\x0bd"), (None, "s1", None), (7001, "none", ""), (7002, "s1", " \t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"size": F.lit("mine"), "rate": F.lit(1), "_mix_rate": F.lit(2)})
    mixed = mixing.mix(df)
    got = mixed.collect()
    sizes, taken = {}, {}
    for row in got:
        assert row.size == len(re.findall(r"[^\x20\x09-\x0d]+", row.text or "")) and 0 <= row.copies <= 3 and row.rate == 1
        sizes[row.source] = sizes.get(row.source, 0) + row.size
        taken[row.source] = taken.get(row.source, 0) + row.size * row.copies
    want = shares(sizes)
    for row in got:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(float(want[row.source]))
        assert row.copies in (int(want[row.source] / max(1, sizes[row.source])), int(want[row.source] / max(1, sizes[row.source])) + 1)
    spread = {n: 60 * sum(row.source == n for row in got) ** 0.5 for n in sizes}  # two deviations and more of the draws
    assert all(abs(taken[n] - float(want[n])) <= spread[n] for n in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda x: (repr(x.doc_id), repr(x.source), x.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.emit(mixed).count() == sum(row.copies for row in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_stays_with_dataframe_functions(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "b")], "doc_id long, source string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- manifest ----------------------------------------------------------------------------------------------


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def plain_manifest(rows, arity):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, sha(encoded(*row)), row))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    grown = {n: levels([x[2] for x in sorted(trees[n], key=lambda x: x[:3])], arity) for n in names}
    top = levels([grown[n][-1][0] for n in names], arity)
    for at, n in enumerate(names):
        for i, (_, _, leaf, (doc_id, source, lang, n_chars, text)) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            bad = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            fold, siblings = sha(encoded(doc_id, source, lang, n_chars + bad if bad else n_chars, text)), ""
            for tree, k in ((grown[n], i), (top, at)):
                for nodes in tree[:-1]:
                    run = nodes[k // arity * arity :][:arity]
                    siblings += "".join(d for j, d in enumerate(run) if j != k % arity)
                    run[k % arity] = fold
                    fold, k = sha("".join(run)), k // arity
            yield doc_id, leaf, grown[n][-1][0], top[-1][0], sha(siblings), fold, fold == top[-1][0]


@pytest.mark.parametrize(("arity", "rows_per_part"), [(2, 23), (2, 50_000), (3, 31)])
def test_manifest_equals_plain_trees(spark, arity, rows_per_part):
    r = random.Random(3)
    rows = [(r.choice([None, *range(900)]), r.choice([None, "a"]), r.choice([None, "en", "en", "en", "de", "", "é", "\U0001f600"]), r.choice([None, 3]), r.choice([None, "", "yé" * r.randrange(9)])) for _ in range(700)]
    rows += rows[:30] + [(5, "a", "once", 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "digest": F.lit("x"), "part": F.lit(0)})
    got = merkle.manifest(df, tampered=merkle.tampered_documents(df), arity=arity, rows_per_part=rows_per_part).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows, arity)))
    assert not all(row.verified for row in got)


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    (one,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:1----") and one.proof_sha256 == sha("") and one.verified


@given(st.integers(1, 60), st.integers(2, 4), st.randoms(use_true_random=False))
def test_fragments_merge_in_any_order(size, arity, r):
    leaves = [sha(str(i)) for i in range(size)]
    order = r.sample(range(size), size)
    fragments = []
    while order:
        n = r.randrange(1, len(order) + 1)
        fragments.append(merkle.settle({(0, i): leaves[i] for i in order[:n]}, size, arity)[0])
        order = order[n:]
    while len(fragments) > 1:
        a, b = fragments.pop(r.randrange(len(fragments))), fragments.pop(r.randrange(len(fragments)))
        fragments.append(merkle.settle(a | b, size, arity)[0])
    assert fragments == [{(merkle.height(size, arity), 0): levels(leaves, arity)[-1][0]}]
