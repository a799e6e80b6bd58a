import random
import re

from quarry.llm.linededup import GRAM, WINDOW, dedup_lines, line_report

from .conftest import SCHEMA


def pieces(text):
    return re.split(r"(?<=\n)|(?<=[.!?])(?=[ \t])", text)


def lines(text):
    return [(k, tuple(x.encode().lower().split())) for k, x in enumerate(pieces(text or "")) if x.split()]


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [[line(rng.randint(3, 20)) for _ in range(rng.randint(3, 9))] for _ in range(6)] + [[line(60)]]
    common = [line(4) for _ in range(3)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(rng.randint(1, 5)):
            out += rng.choice(shared) if rng.random() < 0.4 else [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
            if rng.random() < 0.5:
                out.append(rng.choice(common))
        rows.append((d, "\n".join(out), None, None))
    return rows


def test_guarantee_and_nothing_else(spark):
    """Every repeated run of WINDOW words loses GRAM words at least; a line goes only in a run of GRAM words or more that
    stands earlier too."""
    rows = corpus(1)
    gone = {r.doc_id: set(r.removed) for r in line_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert any(gone.values())
    whole = [lines(t) for _, t, *_ in rows]
    runs = {}
    for d, ls in enumerate(whole):
        for a in range(len(ls)):
            for z in range(a, len(ls)):
                key = tuple(x for _, x in ls[a : z + 1])
                runs.setdefault(key, (d, a))
    for d, ls in enumerate(whole):
        for a in range(len(ls)):
            n = 0
            for z in range(a, len(ls)):
                n += len(ls[z][1])
                if n >= WINDOW:
                    if runs[tuple(x for _, x in ls[a : z + 1])] < (d, a):
                        assert sum(len(x) for k, x in ls[a : z + 1] if k in gone[d]) >= GRAM
                    break
        for p, (k, _) in enumerate(ls):
            if k in gone[d]:
                assert any(
                    sum(len(x) for _, x in ls[a : z + 1]) >= GRAM and runs[tuple(x for _, x in ls[a : z + 1])] < (d, a)
                    for a in range(p + 1)
                    for z in range(p, len(ls))
                )


def test_one_long_line_is_a_run(spark):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(3, f"head\n{long}\ntail", None, None), (1, long, None, None), (2, f"{long}\n{long}", None, None)]
    got = {r.doc_id: list(r.removed) for r in line_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [1]}


def test_a_passage_within_paragraphs(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = ". ".join(say(9) for _ in range(7)) + "."
    rows = [(d, f"{say(30)}. {say(20)} {passage} {say(25)}! {say(6)}?", None, None) for d in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.removed_words for r in line_report(df).collect()}
    # the passage's first sentence goes on from another one, so that six of the seven are whole lines
    assert got == {0: 0, 1: 54, 2: 54, 3: 54, 4: 54}
    for r in dedup_lines(df).collect():
        assert r.text == rows[r.doc_id][1].replace(passage[passage.index(".") + 1 :] if r.doc_id else "\0", "")


def test_texts(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    gone = {r.doc_id: set(r.removed) for r in line_report(df).collect()}
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == {d: "".join(x for k, x in enumerate(pieces(t)) if k not in gone[d]) for d, t, *_ in rows}


def test_odd_rows(odd, odd_rows, none):
    got = line_report(odd).collect()
    assert len(got) == len(odd_rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines) for r in got) == sorted((d is not None, d or 0, len(lines(t))) for d, t, *_ in odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[0].removed_lines == 0 and by[20].removed_lines == by[20].n_lines
    out = dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    assert line_report(none).count() == 0 and dedup_lines(none).count() == 0


def test_passages_cut_within_lines(spark):
    """A repeated passage of WINDOW words or more that begins and ends inside lines loses every line whole in it."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        n = WINDOW + k % 51
        head, tail = rng.randint(1, 20), rng.randint(1, 20)
        inner, left = [], n - head - tail
        while left > 0:
            inner.append(say(min(left, rng.randint(3, 40))))
            left -= len(inner[-1].split())
        passage = " ".join([say(head) + ".", *[x + "." for x in inner], say(tail)])
        for d in (2 * k, 2 * k + 1):
            rows.append((d, f"{say(30)}. {say(7)} {passage} {say(5)}. {say(30)}.", None, None))
            want[d] = list(range(2, 2 + len(inner))) if d % 2 else []
    got = {r.doc_id: list(r.removed) for r in line_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want


def test_a_later_holder_of_the_longer_passage(spark):
    """Texts that share more with each other than with the first holder of a part of it lose all of it but once."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    rows, want = [], {}
    for k in range(40):
        part, rest = " ".join(say(9) for _ in range(3)), " ".join(say(9) for _ in range(4))
        for d, x in enumerate((part, f"{part} {rest}", f"{part} {rest}")):
            rows.append((3 * k + d, f"{say(30)} {x} {say(30)}", None, None))
        want |= {3 * k: [], 3 * k + 1: [1, 2, 3], 3 * k + 2: [1, 2, 3, 4, 5, 6, 7]}
    got = {r.doc_id: list(r.removed) for r in line_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want


def test_a_holder_that_repeats_parts_itself(spark):
    """A part that stands twice in the holder hides neither of the runs it belongs to."""
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    rows, want = [], {}
    for k in range(40):
        one, two, rest = say(25), say(25), " ".join(say(8) for _ in range(4))
        rows += [(2 * k, f"{two} {rest} {say(40)} {one} {two} {say(40)}", None, None), (2 * k + 1, f"{one} {two} {rest} {say(40)}", None, None)]
        want |= {2 * k: [7], 2 * k + 1: [0, 1, 2, 3, 4, 5]}
    got = {r.doc_id: list(r.removed) for r in line_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want
