import random

from llm import substring
from llm.words import hashes, shingles, spans

SCHEMA = "doc_id long, text string, key long, doc string, start string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, line = prose(rng, 60), prose(rng, 80)
    near = line.split(" ")
    near[40] = "changed"
    rows = {i: "\n".join(prose(rng, 30) for _ in range(4)) for i in range(12)}
    rows[20] = prose(rng, 30) + " " + passage + " " + prose(rng, 25)
    rows[21] = prose(rng, 40) + " " + passage + "\n" + prose(rng, 25)
    rows[22] = prose(rng, 30) + "\n" + line + "\n" + prose(rng, 30)
    rows[23] = prose(rng, 30) + "\n" + " ".join(near) + "\n" + prose(rng, 30)
    rows[30] = rows[3]
    rows[40] = rows[5] + "\n" + rows[5]  # repeats itself, and another
    return rows, passage


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", None) for i, t in rows], SCHEMA)


def test_finds_planted_passages_only(spark):
    rows, passage = corpus()
    found = substring.repeats(frame(spark, rows.items())).collect()
    assert {r.doc_id for r in found} == {20, 21, 22, 23, 3, 30, 5, 40}
    assert {r.doc_id for r in found if r.removed} == {21, 23, 30, 40}
    cut = next(r for r in found if r.doc_id == 21)
    text = rows[21].encode()[cut.start : cut.end].decode()
    assert text in passage and len(text.split()) == cut.n_words >= 40


def test_removal_and_odd_rows(spark):
    rows, _ = corpus()
    odd = [(None, None), (None, ""), (50, None), (51, "  "), (52, "word " * 30000), (52, "word " * 30000)]
    kept = substring.remove_repeats(frame(spark, [*rows.items(), *odd]))
    texts = {}
    for r in kept.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert kept.columns == ["doc_id", "text", "key", "doc", "start"]
    assert texts[0] == [rows[0]] and texts[20] == [rows[20]] and texts[22] == [rows[22]]
    assert len(texts[21][0].split()) <= len(rows[21].split()) - 40
    assert 30 not in texts or len(texts[30][0].split()) < 30
    assert sorted(texts[None], key=str) == ["", None] and texts[50] == [None] and texts[52] == ["word " * 30000]


def test_empty(spark):
    assert substring.repeats(frame(spark, [])).collect() == []
    assert substring.remove_repeats(frame(spark, [])).collect() == []


def test_bands_recall():
    number, rows = substring.bands()
    assert 1 - (1 - 0.8**rows) ** number >= substring.RECALL


def test_word_hashes():
    data = b"  one two\tthree \n two"
    start, end = spans(data)
    h = hashes(data, start, end)
    assert [data[a:b] for a, b in zip(start, end)] == data.split() and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(shingles(h, 5)) == 0 and len(shingles(h, 2)) == 3


def test_spliced_passages_whole(spark):
    """Repeats of 25 to 60 words inside otherwise different lines, at any place, from the first word to the last."""
    rng = random.Random(8)
    rows, expected = {}, {}
    for k, n in enumerate([25, 26, 27, 30, 35, 40, 45, 51, 60] * 3):
        passage = prose(rng, n)
        rows[k] = f"{prose(rng, 7 + k)} {passage} {prose(rng, 30)}"
        rows[100 + k] = f"{prose(rng, 3 * k)} {passage}\n{prose(rng, 2)}".strip()
        expected[100 + k] = passage
    rows |= {300 + k: f"{prose(rng, 30)} {text} {prose(rng, 30)}" for k, text in enumerate([prose(rng, 24)] * 2)}
    found = [r for r in substring.repeats(frame(spark, rows.items())).collect() if r.removed]
    assert {r.doc_id: rows[r.doc_id].encode()[r.start : r.end].decode() for r in found} == expected and len(found) == len(expected)
    assert all(r.n_words == len(expected[r.doc_id].split()) and r.first_doc == r.doc_id - 100 for r in found)


def test_paragraphs_of_short_lines():
    own = substring.Texts(["a b c d e f\ng h\n\ni j k l m\n" + "x " * 20 + "\nn", "o p\nq r s t", None, "u", "v w x y"])
    words = own.data.split()
    first, last, parent = own.paragraphs()
    found = sorted(b" ".join(words[a:b]).decode() for a, b in zip(first, last))
    assert {(int(first[k]), int(first[p])) for k, p in enumerate(parent) if p >= 0} == {(0, 0)}
    assert found == sorted(["a b c d e f", "a b c d e f g h", "i j k l m", ("x " * 20).strip(), "o p q r s t"])


def test_short_and_wrapped_paragraphs(spark):
    """Short lines that stand alone, and a near copy of a paragraph that is wrapped otherwise."""
    rng = random.Random(9)
    words = prose(rng, 26).split(" ")
    wrap = lambda some, n: "\n".join(" ".join(some[k : k + n]) for k in range(0, len(some), n))
    near = [words[0], "changed", *words[2:]]  # Jaccard 20 / 24, and no 25 words in a row are the same
    rows = {0: f"{prose(rng, 40)}\n\n{wrap(words, 11)}\n\n{prose(rng, 40)}", 1: f"{prose(rng, 30)}\n\n{wrap(near, 14)}\n\n{prose(rng, 30)}"}
    for k, n in enumerate((5, 8, 12, 19, 20, 22, 24)):
        line = prose(rng, n)
        rows |= {10 + 2 * k: f"{prose(rng, 30)}\n{line}\n{prose(rng, 30)}", 11 + 2 * k: f"{prose(rng, 40)}\n{line}\n{prose(rng, 40)}"}
    found = {r.doc_id: r.n_words for r in substring.repeats(frame(spark, rows.items())).collect() if r.removed}
    assert found == {1: 26, 11: 5, 13: 8, 15: 12, 17: 19, 19: 20, 21: 22, 23: 24}


def removed_texts(spark, rows):
    found = substring.remove_repeats(frame(spark, rows)).select("doc_id", "text").collect()
    return sorted(((r.doc_id, r.text) for r in found), key=str)


def test_rows_of_one_id_are_cut_by_their_own_passages(spark):
    rng = random.Random(10)
    passage, other, x = prose(rng, 40), "\u6f22\u5b57 " * 3 + " ".join(f"\u6f22{k}" for k in range(200)), prose(rng, 30)
    rows = [(1, f"{prose(rng, 30)} {passage}"), (5, f"{passage} {x}"), (5, other)]
    assert removed_texts(spark, rows) == sorted([rows[0], (5, x), rows[2]], key=str)


def test_rows_without_an_id_are_documents(spark):
    rng = random.Random(11)
    passage, a, b = prose(rng, 40), prose(rng, 30), prose(rng, 30)
    kept = removed_texts(spark, [(None, f"{a} {passage}"), (None, f"{b} {passage}"), (None, None)])
    assert sum(passage in (t or "") for _, t in kept) == 1 and sum(len((t or "").split()) for _, t in kept) == 100 and len(kept) == 3
    found = substring.repeats(frame(spark, [(None, a), (None, a), (7, a)])).collect()
    assert sorted((str(r.doc_id), r.removed, r.first_doc) for r in found) == [("7", False, 7), ("None", True, 7), ("None", True, 7)]


def test_what_leaves_with_a_near_copy_stays_elsewhere(spark):
    rng = random.Random(12)
    paragraph, s, x = prose(rng, 300), prose(rng, 40), prose(rng, 30)
    assert removed_texts(spark, [(0, paragraph), (1, f"{paragraph} {s}"), (2, f"{x}\n{s}")]) == [(0, paragraph), (2, f"{x}\n{s}")]
    # Only in near copies that go: every 25 words that only these share stay in the first of them.
    kept = removed_texts(spark, [(0, paragraph), (1, f"{paragraph} {s}"), (2, f"{paragraph} {s}")])
    assert kept == [(0, paragraph), (1, " ".join(paragraph.split()[-24:] + [s]))]


def windows(text, n=substring.PASSAGE):
    own = text.split()
    return {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}


def test_every_repeated_passage_stays_somewhere(spark):
    """Random texts of shared passages and lines, of which near copies are made: no word of a repeat is lost."""
    rng = random.Random(13)
    pool = [prose(rng, rng.randint(25, 60)) for _ in range(12)] + [prose(rng, rng.randint(5, 19)) for _ in range(12)]
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.4:  # a near copy: words changed, a line added or dropped
            own = rows[rng.randrange(len(rows))][1].split("\n")
            own = [" ".join(w if rng.random() > 0.03 else prose(rng, 1) for w in line.split(" ")) for line in own]
            if rng.random() < 0.5:
                own.insert(rng.randrange(len(own) + 1), rng.choice(pool))
        else:
            own = []
            for _ in range(rng.randint(2, 6)):
                part = rng.choice([prose(rng, rng.randint(5, 40)), rng.choice(pool), rng.choice(pool)])
                own += rng.choice([[part], [part, ""], [prose(rng, 4) + " " + part], [" ".join(part.split(" ")[k : k + 9]) for k in range(0, len(part.split(" ")), 9)]])
        rows.append((rng.choice([i, i, i, i // 3, None]), "\n".join(own)))
    kept = removed_texts(spark, rows)
    count = {}
    for _, t in rows:
        for unit in windows(t) | {tuple(line.split()) for line in t.split("\n") if len(line.split()) >= 5}:
            count[unit] = count.get(unit, 0) + 1
    words = set(" ".join(t for _, t in kept).split())
    assert {w for unit, n in count.items() if n > 1 for w in unit} <= words
    assert sum(len(t.split()) for _, t in kept) < 0.7 * sum(len(t.split()) for _, t in rows)
    found = substring.repeats(frame(spark, rows)).select("doc_id", "n_words", "removed").collect()
    assert sum(r.n_words for r in found if r.removed) == sum(len(t.split()) for _, t in rows) - sum(len(t.split()) for _, t in kept)


def brute(rows):
    """(row, word) places that are repeated: in 25 words that two rows share, or in lines or runs of short lines whose class is in two rows."""
    places, units = set(), []
    seen = {}
    for r, (_, t) in enumerate(rows):
        own = t.split()
        for k in range(len(own) - 24):
            seen.setdefault(tuple(own[k : k + 25]), []).append((r, k))
        lines, at = [], 0
        for line in t.split("\n"):
            lines.append((at, at + len(line.split())))
            at = lines[-1][1]
        runs, run = [], []
        for a, b in [*lines, (0, 99)]:
            if 0 < b - a < substring.LINE:
                run.append((a, b))
                continue
            if len(run) > 1:
                runs.append((run[0][0], run[-1][1]))
            run = []
        units += [(r, a, b, frozenset(tuple(own[k : k + 5]) for k in range(a, b - 4))) for a, b in lines + runs if b - a >= 5]
    for found in seen.values():
        if len({r for r, _ in found}) > 1:
            places |= {(r, k + j) for r, k in found for j in range(25)}
    up = list(range(len(units)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(units)):
        for j in range(i):
            both = len(units[i][3] & units[j][3])
            if both >= 0.8 * (len(units[i][3]) + len(units[j][3]) - both):
                up[find(i)] = find(j)
    classes = {}
    for k, u in enumerate(units):
        classes.setdefault(find(k), []).append(u)
    for some in classes.values():
        if len({u[0] for u in some}) > 1:
            places |= {(u[0], w) for u in some for w in range(u[1], u[2])}
    return places, seen


def test_against_brute_force(spark):
    """What is reported is repeated, and of every 25 words that rows share one copy at least is reported."""
    rng = random.Random(21)
    pool = [prose(rng, rng.randint(25, 50)) for _ in range(6)] + [prose(rng, rng.randint(5, 19)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice([prose(rng, rng.randint(3, 40)), rng.choice(pool), " ".join(w if rng.random() > 0.02 else "other" for w in rng.choice(pool).split())]) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice(["\n", "\n\n", " "]).join(parts)))
    expected, seen = brute(rows)
    covered = set()
    for r in substring.repeats(frame(spark, rows)).collect():
        data = rows[r.doc_id][1].encode()
        first = len(data[: r.start].split())
        assert len(data[r.start : r.end].split()) == r.n_words
        covered |= {(r.doc_id, first + k) for k in range(r.n_words)}
    assert covered <= expected
    for words, found in seen.items():
        if len({r for r, _ in found}) > 1:
            assert any((r, k + j) in covered for r, k in found for j in range(25)), words
    assert len(covered) > 0.9 * len(expected)
