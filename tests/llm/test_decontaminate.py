import random
import tracemalloc

import pytest

from batchloom.llm import decontaminate
from batchloom.llm.decontaminate import SEGMENT, Index, contamination, drop_contaminated


def words(rng, n):
    return [f"{''.join(rng.choices('etaoinshr', k=rng.randrange(2, 9)))}" for _ in range(n)]


def stored(spark, tmp_path, rows, schema, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def planted():
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 40))) for i in range(12)] + [(90, None), (91, "too short"), (92, ""), (93, " ".join(words(rng, 9)))]
    prose = lambda n: " ".join(words(rng, n))
    text = dict(items)
    edit = lambda t: t.replace("e", "X", 2).upper() + "!"
    half = lambda t: " ".join(t.split()[:25])
    phrase = lambda t: " ".join(t.split()[:6])
    docs = [(0, prose(200), []), (1, prose(50) + " " + text[3] + " " + prose(70), [3]), (2, text[4].replace(" ", "###\n"), [4]), (3, prose(30) + edit(text[5]) + prose(900), [5]),
            (4, half(text[6]), [6]), (5, prose(80) + " " + phrase(text[7]) + " " + prose(80), []), (6, text[1] + text[2], [1, 2]), (7, None, []), (8, "", []), (9, text[93], [93]),
            (10, prose(60_000) + " " + text[8], [8]), (None, text[0], [0]), (1, prose(5) + " " + text[3], [3]),
            (11, prose(30) + "\n- Too SHORT!\n" + prose(30), [91]), (12, prose(30) + " too short " + prose(30), []), (13, "too short\n" + text[2], [2, 91])]
    return items, docs


def test_planted_passages(spark, tmp_path, monkeypatch):
    items, docs = planted()
    bench = stored(spark, tmp_path, items, "item_id long, text string", "bench")
    table = stored(spark, tmp_path, [(i, t, "x", "y") for i, t, _ in docs], "doc_id long, text string, row string, edits string", "docs")
    want = sorted((i or 0, e) for i, _, e in docs)
    found = contamination(table, bench).collect()
    assert sorted((r.doc_id or 0, r.item_ids) for r in found) == want
    assert all(r.contaminated == bool(r.item_ids) for r in found)
    clean = drop_contaminated(table, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, e in want if not e and i is not None] and clean.columns == table.columns
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 600)  # several passes
    assert sorted((r.doc_id or 0, r.item_ids) for r in contamination(table, bench).collect()) == want
    assert drop_contaminated(table, bench).count() == clean.count()


def test_items_that_share_a_prompt_in_bounded_memory():
    """A text that repeats the beginning of thousands of items; nothing is lost in the parts that it is searched in."""
    rng = random.Random(11)
    prompt = " ".join(words(rng, 30))
    items = [(i, f"{prompt} {' '.join(words(rng, 20))}") for i in range(2000)]
    index, table = Index.build(items), decontaminate._fold_table()
    text = " ".join([prompt] * 120) + " " + items[1234][1][len(prompt) - 40 :]
    tracemalloc.start()
    found = decontaminate._hits([text, "", None], index, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found[0]) == set(range(2000)) and found[0][1234] == 0 and found[1:] == [{}, {}]
    assert peak < 400e6


@pytest.mark.parametrize("block", [100, 333])
def test_long_texts_in_parts(monkeypatch, block):
    """Texts longer than a block give what they give as one."""
    rng = random.Random(block)
    items = [(i, "".join(rng.choices("abcdefgh ", k=200))) for i in range(3)] + [(9, "brief one")]
    index, table = Index.build(items), decontaminate._fold_table()
    texts = ["".join(rng.choices("uvwxyz .\n", k=rng.randrange(400))) + rng.choice(items)[1][rng.randrange(60) :][:110] + "\nBrief one!\n" * rng.randrange(2) + "".join(rng.choices("uvw ", k=rng.randrange(900))) for _ in range(40)]
    whole = decontaminate._hits(texts, index, table)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "POSTINGS", 50)
    assert decontaminate._hits(texts, index, table) == whole and sum(map(bool, whole)) > 20


def test_empty_tables(spark, tmp_path):
    items, docs = planted()
    none = stored(spark, tmp_path, [], "item_id long, text string", "bench")
    table = stored(spark, tmp_path, [(i, t) for i, t, _ in docs], "doc_id long, text string", "docs")
    assert contamination(table, none).filter("contaminated").count() == 0
    empty = stored(spark, tmp_path, [], "doc_id long, text string", "empty")
    assert contamination(empty, none).count() == 0


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_filter_and_alignment_by_force():
    """Every segment within its budget is found, with its least edits; none beyond is."""
    rng = random.Random(4)
    item = "".join(rng.choices("abcdef", k=SEGMENT))
    index = Index.build([(1, item)])
    table = decontaminate._fold_table()
    for trial in range(150):
        text = list(item)
        for _ in range(rng.randrange(0, 10)):
            at = rng.randrange(len(text))
            kind = rng.randrange(3)
            if kind == 0:
                text[at] = rng.choice("abcdefxyz")
            elif kind == 1:
                del text[at]
            else:
                text.insert(at, rng.choice("abcdefxyz"))
        whole = "".join(rng.choices("uvw", k=30)) + "".join(text) + "".join(rng.choices("uvw", k=30))
        _, _, edits = index.search(table[decontaminate._points(whole)])
        least = edit_distance_in(item, whole)
        assert (len(edits) > 0) == (least <= index.edits[0])
        if len(edits):
            assert edits.min() == least


def test_exact_quotes_at_every_offset():
    """A quote of SEGMENT letters or more counts wherever in its item it begins, and one of half as many does not."""
    rng = random.Random(5)
    items = [(i, "".join(rng.choices("abcdefghij", k=n))) for i, n in enumerate((300, 200, 107))]
    index, table = Index.build(items), decontaminate._fold_table()
    around = lambda quote: "".join(rng.choices("uvw", k=40)) + quote + "".join(rng.choices("uvw", k=40))
    for length in (SEGMENT, 80, 90, 106):
        quotes = [(i, around(text[at : at + length])) for i, text in items for at in range(len(text) - length + 1)]
        found = decontaminate._hits([q for _, q in quotes], index, table)
        assert found == [{i: 0} for i, _ in quotes]
    parts = [around(text[at : at + SEGMENT // 2]) for _, text in items for at in range(len(text) - SEGMENT // 2)]
    assert not any(decontaminate._hits(parts, index, table))


def test_edited_quotes_by_force():
    """Items, least edits and documents are those of every segment compared with every text; a quote of one document does not settle its neighbours."""
    rng = random.Random(7)
    items = [(7, "".join(rng.choices("abcd", k=150))), (8, "".join(rng.choices("abcd", k=50)))]
    index, table = Index.build(items), decontaminate._fold_table()
    texts = []
    for _ in range(25):
        item = rng.choice(items)[1]
        at = rng.randrange(max(1, len(item) - 80))
        quote = list(item[at : at + 80])
        for _ in range(rng.choice((0, 2, 4, 6, 8))):
            quote[rng.randrange(len(quote))] = rng.choice(("", "x", "ab"))
        texts.append("".join(quote) + "".join(rng.choices("uvw", k=rng.randrange(30))))
    want = []
    for text in texts:
        hits = {}
        for k, (i, item) in enumerate(items):
            size = int(index.lengths[k])
            least = min(edit_distance_in(item[at : at + size], text) for at in range(len(item) - size + 1))
            if least <= index.edits[k]:
                hits[i] = least
        want.append(hits)
    assert decontaminate._hits(texts, index, table) == want and any(any(h.values()) for h in want)
