import hashlib
import re
from fractions import Fraction

from pagemine.llm import mixing
from tests.llm.conftest import by_row


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source -> words. Water-filling by trying every number of capped sources."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and Fraction(w[s] * rest, weight) > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else w[s] * rest / weight for s in names}
        capped |= over


def brute(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes)
    out = []
    for i, s, n in sized:
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"mix-1:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((i, n, sizes[s], goal[s], int(rate) + (draw < rate - int(rate))))
    return out


def test_copies_follow_the_targets(odd_docs, odd_table):
    got = mixing.mixed(odd_table.drop("size")).select("doc_id", "size", "source_size", "target", "copies").collect()
    assert by_row(got) == by_row(brute(odd_docs))


def test_emitted_rows_and_columns(odd_docs, odd_table):
    got = mixing.emitted(odd_table)
    assert got.columns == odd_table.columns
    assert got.count() == sum(row[-1] for row in brute(odd_docs))


def test_taken_words_come_near_the_targets_and_targets_share_all_words(spark):
    rows = [(i, "w " * (20 + i % 60), f"s{(i % 7) if i % 3 else 0}") for i in range(6000)] + [(6000, "few words", "s9"), (6001, None, "sz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    per = {}
    for r in got:
        goal, taken = per.get(r.source, (r.target, 0))
        per[r.source] = (goal, taken + r.size * r.copies)
        assert r.copies <= 3
    assert abs(sum(goal for goal, _ in per.values()) - sum(r.size for r in got)) < 1e-6
    for source, (goal, taken) in per.items():
        if source in ("s9", "sz"):
            assert taken == goal
        else:
            assert abs(taken - goal) < 0.1 * goal
    assert by_row(mixing.mixed(docs).collect()) == by_row(got)


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mixed(docs).collect()] == [0, 0]
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_main_path_runs_no_python(odd_table):
    plan = mixing.mixed(odd_table)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
