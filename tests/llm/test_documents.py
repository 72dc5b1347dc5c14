"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re

import pytest

from tests.llm import brute
from tidemark.llm import decontam, line_dedup, license_scan, ngram_join, quality_gbt, quality_rules, sentencepiece_codec, substring_dedup
from tidemark.llm.queries import TOKENIZER

SCHEMA = "doc_id bigint, text string, lang string, n_lines string, key string, term string, contaminated string, n bigint"
EDGES = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One  TWO"), (9005, "one two"), (9006, "x"), (9007, "É ÄB\u0130 Straße ① \x0b q"), (9008, "long " * 5000 + "tail\n" * 3000)]


def made(seed=7):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "漢字", "ß,", "The", "the"]
    pieces = [[r.choice(vocabulary) for _ in range(r.randint(5, 50))] for _ in range(12)]
    rows = []
    for i in range(240):
        if i % 3 == 0 and rows:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = sum((r.choice(pieces) + [r.choice([" ", "\n", "  "])] for _ in range(r.randint(0, 5))), [])
        rows.append((i * 7 % 1683, " ".join(w)))
    return rows + EDGES


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "own", "k", "t", "c", 5) for i, t in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lines(docs, empty):
    rows = line_dedup.dedup(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in rows} == brute.lines(ROWS) and len(rows) == len(ROWS)
    assert rows[0].key == "k" and rows[0].lang == "en"
    assert line_dedup.dedup(empty).count() == 0


def test_lines_of_repeated_rows_and_rows_without_id(spark):
    rows = [(1, "a line of text\nshared by all"), (1, "shared by all"), (2, "Shared by ALL \nown line here"), (2, "Shared by ALL \nown line here"), (None, "shared by all"), (None, None)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), batches=2, fanout=2).collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r.text) for r in out) == [(0, 0, ""), (0, 0, "shared by all"), (1, 0, "a line of text\nshared by all"), (1, 0, "shared by all"), (2, 1, "own line here"), (2, 1, "own line here")]


def test_lines_over_many_levels_and_jobs(spark, docs, tmp_path):
    expected, at = brute.lines(ROWS), str(tmp_path / "runs")
    of = lambda rows: {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in rows.collect()}
    assert of(line_dedup.dedup(docs, batches=9, fanout=2)) == expected
    # Two jobs on one folder; the first one is run twice, as after a failure, and a run that broke off is left out.
    first, second = docs.where("doc_id < 120"), docs.where("doc_id >= 120")
    line_dedup.dedup(first, batches=2, fanout=2, folder=at)
    (tmp_path / "runs" / "0-4-broken").mkdir()
    assert of(line_dedup.dedup(first, batches=3, fanout=2, folder=at)) | of(line_dedup.dedup(second, batches=3, fanout=2, folder=at)) == expected
    held = line_dedup.LineRuns(spark, 2, at)
    assert max(level for level, runs in enumerate(held.levels) if runs) >= 2 and all(len(runs) < 2 for runs in held.levels)
    held.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("shard", [96, 4])
def test_groups(docs, empty, monkeypatch, shard):
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()} == brute.groups(ROWS)
    assert ngram_join.join(empty).count() == 0


def test_groups_of_repeated_rows_and_rows_without_id(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, "only this one has no id"), (7, ""), (8, "")]
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in out if r.component_id is not None) == [(0, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8)] and len(out) == 7


def test_groups_joined_by_a_row_without_id(spark):
    w = [f"w{k}" for k in range(200)]
    rows = [(4, " ".join(w)), (None, " ".join([*w[:-20], *"abcdefghijklmnopqrst"])), (9, " ".join([*w[20:-20], *"abcdefghijklmnopqrst", *(f"z{k}" for k in range(20))])), (None, "x y z a b c d"), (None, "x y z a b c d"), (-3, "q r s t")]
    want = brute.groups([(1000 + i if d is None else d, t) for i, (d, t) in enumerate(rows)])
    assert want[9][1] == want[1001][1] == 4  # only through the row without doc_id
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(4, 4), (None, 4), (9, 4), (None, None), (-3, -3)} and len(out) == 6


def test_a_chain_of_candidates_without_links_stays_linear(spark):
    """Each text overlaps with the next one, none enough to link: one component of candidates, of more than a hundred times SHARD sets."""
    def pairs(n):
        texts = spark.range(n).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(id * 8, id * 8 + 19), x -> concat('w', x))) as text")
        table = ngram_join.profile(texts)
        sets = ngram_join.shared(texts, ngram_join.heavy_shingles(table, 16 * n), 16 * n).selectExpr("k1 as node", "n", "unshared", "ordered")
        size = ngram_join.grouped(*ngram_join.prefix_lists(sets)).groupBy("hub").count()
        return size.selectExpr("sum(count * count)").first()[0], texts

    n = 110 * ngram_join.SHARD
    few, texts = pairs(n)
    many, _ = pairs(2 * n)
    assert 0 < few < 20 * n and many < 2.2 * few
    assert ngram_join.join(texts).where("component_id = doc_id").count() == n


@pytest.mark.parametrize("shard", [96, 8])
def test_long_lists_without_links(spark, monkeypatch, shard):
    """Texts that share a phrase, which holds their prefix, and differ otherwise in words that others have too."""
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    r = random.Random(5)
    phrases = [" ".join(f"p{i}x{k}" for k in range(9)) for i in range(9)]
    rows = [(i, " ".join(r.sample(phrases, r.choice([2, 3])))) for i in range(300)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == brute.groups(rows)


def test_representatives(docs):
    want = {i for i, (_, c) in brute.groups(ROWS).items() if i == c}
    kept = ngram_join.representatives(docs)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_contamination(spark, docs, empty):
    r = random.Random(3)
    items = [(k, " ".join(brute.words(r.choice(ROWS)[1])[2 : 2 + n])) for k, n in enumerate([30, 20, 13, 14, 5, 1, 40])] + [(90, None), (91, ""), (92, "never seen words stand here alone and so on for more than thirteen"), (2, "tail")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.judge(docs, bench).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.item_ids) for x in rows} == brute.contaminated(ROWS, items) and len(rows) == len(ROWS)
    some = [i for i in items if i[0] != 90]  # 9008 holds one word thousands of times
    assert {x.doc_id: x.n_near_items for x in rows if x.doc_id != 9008} == brute.near_items([r for r in ROWS if r[0] != 9008], some, decontam.SLOP)
    assert all(x.contaminated == (x.n_hit > 0 and 20 * x.n_hit >= x.n_words) and x.key == "k" for x in rows)
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {x.doc_id for x in rows if not x.contaminated}
    assert decontam.judge(empty, bench).count() == 0
    assert decontam.judge(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_an_item_of_one_common_word(spark):
    """Candidates are one row a document, not one an occurrence, and carry no items or terms."""
    rows = [(i, "the " * (500 if i % 2 else 40) + f"w{i}") for i in range(60)] + [(100, "no such word"), (None, "the"), (None, "the")]
    items = [(i, "The") for i in range(50)] + [(70, "the the"), (71, "w3 the")]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, len(x.item_ids), x.n_near_items, x.contaminated) for x in decontam.judge(docs, bench).collect()}
    assert got[1] == (501, 500, 51, 51, True) and got[2] == (41, 40, 51, 51, True) and got[100] == (3, 0, 0, 0, False) and got[None] == (1, 1, 50, 51, True)
    assert got[3] == (501, 500, 51, 52, True)  # "the" before "w3" is near, not exact
    assert decontam.clean(docs, bench).count() == 1
    index = decontam.postings(decontam.tokens(docs), spark.createDataFrame([("the",)], "term string"))
    assert index.count() == 61 and index.selectExpr("max(size(positions))").first()[0] == 500


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b a"), (2, "a x x x x x b")], "doc_id bigint, text string")
    index = decontam.postings(decontam.tokens(docs), spark.createDataFrame([("a",), ("b",)], "term string"))
    near = decontam.proximity(index, spark.createDataFrame([(7, "a", "b")], "item_id bigint, a string, b string"), slop=3)
    assert sorted((r.item_id, r.doc_id, r.pos_a, r.pos_b) for r in near.collect()) == [(7, 1, 0, 3), (7, 1, 4, 3)]


@pytest.mark.parametrize(("unit", "hot"), [(1 << 23, 1 << 14), (400, 1 << 14), (400, 3)])
def test_passages(docs, empty, monkeypatch, unit, hot):
    monkeypatch.setattr(substring_dedup, "UNIT", unit)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = substring_dedup.dedup(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute.passages(ROWS) and len(rows) == len(ROWS)
    assert rows[0].key == "k" and rows[0].n == 5
    assert substring_dedup.dedup(empty).count() == 0


def test_passages_of_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(20))
    out = substring_dedup.dedup(spark.createDataFrame([(4, text), (None, text), (2, f"x {text}"), (4, text)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (2, 0), (4, 20), (4, 20)]


def test_fm_index_against_brute_force():
    import numpy as np

    from tidemark.llm.fm_index import FMIndex, streamed

    r = np.random.default_rng(1)
    for words, n in ((2, 40), (4, 20), (50, 8)):
        lengths = r.integers(13, 40, n)
        text = r.integers(0, words, lengths.sum()) * 10 + 5
        value = r.integers(0, 1000, n)
        index = FMIndex(text, lengths, value)
        least = {}
        for part, v in zip(np.split(text, np.cumsum(lengths)[:-1]), value, strict=True):
            for k in range(len(part) - 12):
                w = tuple(part[k : k + 13])
                least[w] = min(v, least.get(w, FMIndex.NONE))
        # Texts that the index doesn't hold, some of them with symbols that it doesn't know, beside all that it holds.
        others = [np.concatenate([text[:20], r.integers(0, words, 9) * 10 + 5, [7777], text[3:30]]), np.full(14, 9)]
        foreign = np.concatenate([text, *others])
        sizes = np.append(lengths, [len(x) for x in others])
        want = [least.get(tuple(p[k : k + 13]), FMIndex.NONE) for p in np.split(foreign, np.cumsum(sizes)[:-1]) for k in range(len(p) - 12)]
        assert index.matches(foreign, sizes).tolist() == want
        assert np.concatenate([*streamed(index, foreign, sizes, chunk=50)]).tolist() == want


def test_fm_index_is_compressed_and_searched():
    import numpy as np

    from tidemark.llm.fm_index import FMIndex

    r = np.random.default_rng(2)
    lengths = np.full(4000, 25)
    text = r.zipf(1.3, lengths.sum()) % 5000 << 20  # symbols of eight bytes each
    index = FMIndex(text, lengths, np.arange(4000))
    assert index.nbytes < 4.5 * index.size
    arrays = [x for x in vars(index).values() if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in arrays if x is not index.value) < index.size  # no suffix array, no text, nothing by position
    found = index.matches(text, lengths)
    index.step = lambda symbol, lo, hi: (lo, lo)
    assert (found < 4000).all() and (index.matches(text, lengths) == FMIndex.NONE).all()


def test_passages_need_the_search(spark, monkeypatch):
    """With a search that finds nothing, nothing is removed: no other path gives results."""
    import pyarrow as pa

    from tidemark.llm import fm_index

    text = " ".join(f"w{k}" for k in range(20))
    u = substring_dedup.Unit(pa.array([text, text]))
    symbols = u.hashes()[substring_dedup.ragged(u.start, u.windows + 12)] >> 24
    rows = substring_dedup._batch([0], [0], substring_dedup.SEGMENTS, [u.windows.astype("uint8").tobytes()], [substring_dedup._packed(symbols, 5).tobytes()], [u.text.astype("int64").tobytes()])
    owners = lambda: set(substring_dedup.np.cumsum(substring_dedup.np.frombuffer(substring_dedup._match(pa.Table.from_batches([rows]))["a"][0].as_py(), "int64")).tolist())
    assert owners() == {0}
    monkeypatch.setattr(fm_index.FMIndex, "step", lambda self, symbol, lo, hi: (lo, lo))
    assert owners() == {fm_index.FMIndex.NONE}


def test_prose_of_other_languages_is_kept(spark):
    texts = {
        1: "Старый маяк стоит на краю мыса и каждую ночь посылает свой свет далеко в море, чтобы рыбаки могли найти дорогу домой. " * 1 + "Зимой волны поднимаются до самых окон, а летом сюда приезжают дети, собирают камни и слушают рассказы смотрителя о кораблях, бурях, китах и далёких островах, где никогда не бывает снега и где люди говорят на языке, которого здесь никто не понимает.",
        2: "Το παλιό σπίτι βρίσκεται κοντά στη θάλασσα και κάθε πρωί ο ήλιος μπαίνει από τα μεγάλα παράθυρα του δωματίου όπου η γιαγιά μου έφτιαχνε ψωμί για όλη την οικογένεια όταν ήμασταν μικρά παιδιά και παίζαμε στον κήπο με τα σκυλιά μέχρι να νυχτώσει και να μας φωνάξει η μητέρα μας να γυρίσουμε πίσω για φαγητό μαζί με όλους τους γείτονες",
        3: "W małym mieście nad rzeką żyła kobieta, która piekła chleb i sprzedawała go na rynku każdego ranka. Ludzie mówili, że w jej chlebie jest coś niezwykłego, i przychodzili z daleka, żeby go kupić. Nie znała nikogo z rodziny, ale na święta zawsze zapraszała sąsiadów do stołu, na którym stały miód, ser i gorąca zupa z grzybów.",
        4: " ".join(f"zq{k}x" for k in range(80)),
    }
    rows = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame([*texts.items()], "doc_id bigint, text string")).collect()}
    assert {i: (r.kept, r.failed_rules) for i, r in rows.items()} == {1: (True, []), 2: (True, []), 3: (True, []), 4: (False, ["stop_words"])}
    assert all(r.n_words >= 50 for r in rows.values())


def test_rules(docs, empty):
    rows = quality_rules.judge(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: brute.repeats(t) for i, t in ROWS} and len(rows) == len(ROWS)
    texts = dict(ROWS)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.word_chars == sum(map(len, brute.words(t))) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and not r.failed_rules)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality_rules.judge(empty).count() == 0


def test_licences(docs, empty, spark):
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert len(out) == len(ROWS) and not any(r.licenses for r in out.values())
    rows = [(1, "some more prose stands here\nreleased under  the MIT license"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "MIT MIT MIT MIT"), (4, None), (4, "All rights reserved.\nLicensed under CC BY-NC 4.0.\nThen come many words of prose on other things.")]
    found = {(r.doc_id, r.best_license): (r.licenses, r.best_dice, r.n_passages) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1, "MIT"] == (["MIT"], 1.0, 1) and found[2, "GPL-3.0"] == (["GPL-3.0"], 1.0, 1) and found[3, None] == ([], 0.0, 0)
    assert found[4, "CC-BY-NC-4.0"] == (["CC-BY-NC-4.0", "Proprietary"], 1.0, 2) and found[4, None] == ([], 0.0, 0)
    assert license_scan.scan(empty).count() == 0


def test_licences_over_several_lines_and_inside_lines(spark):
    import textwrap

    prose = " ".join(f"filler{k} stands here" for k in range(400))
    texts = license_scan.bodies()
    rows = [
        (1, f"{prose}\n" + textwrap.fill(texts["MIT"][0], 40) + f"\n{prose}"),
        (2, "Prose goes first. Copyright X. Licensed under CC BY 4.0. More prose comes after it."),
        (3, texts["GPL-3.0"][0]),
        (4, f"{prose}\n# " + "\n# ".join(texts["BSD-3-Clause"][0].splitlines())),
        (None, f"{prose} This work is licensed under the GNU General\nPublic License, version 3. {prose}"),
        (6, f"{prose} copyright and permission, free of charge {prose}"),
        (7, f"{prose}\nLicensed under CC BY 4.0.\n{prose}"),
        (8, "\n\n".join([prose, texts["MIT"][0], prose, texts["Apache-2.0"][0], prose])),
    ]
    got = {r.doc_id: (r.licenses, r.n_passages, r.best_dice) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: g[:2] for i, g in got.items()} == {1: (["MIT"], 1), 2: (["CC-BY-4.0"], 1), 3: (["GPL-3.0"], 1), 4: (["BSD-3-Clause"], 1), None: (["GPL-3.0"], 1), 6: ([], 0), 7: (["CC-BY-4.0"], 1), 8: (["Apache-2.0", "MIT"], 3)}  # the Apache text ends with a line that matches by itself
    assert all(got[i][2] > 0.99 for i in (1, 2, 3, None, 7, 8))


def test_no_licence_text_can_match_without_its_telling_stems():
    texts = [t for variants in license_scan.bodies().values() for t in variants]
    stems = license_scan.telling_stems(texts)
    assert len(stems) < 200 and len({*stems}) == len(stems)
    for text in texts:
        words = re.findall(r"[^\W_]+", text.lower())
        pairs = {*zip(words, words[1:])}
        left = sum(not any(s in w for s in stems for w in p) for p in pairs)
        assert 200 * left < license_scan.THRESHOLD * (left + len(pairs))


def test_a_licence_text_without_the_templates_words_is_found(spark):
    words = [w for w in re.findall(r"[^\W_]+", license_scan.bodies()["CC0-1.0"][0].lower()) if not any(t in w for numbers in (6, -20) for t in license_scan.telling_words(numbers=numbers))]
    (row,) = license_scan.scan(spark.createDataFrame([(1, "prose stands here " + " ".join(words))], "doc_id bigint, text string")).collect()
    assert row.licenses == ["CC0-1.0"] and row.n_passages == 1


def test_classifier_edges(docs, empty, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in ROWS[:20]] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    rows = quality_gbt.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and len({r.score for r in rows}) == 1 and rows[0].predicted == 1
    assert quality_gbt.classify(empty, labels).count() == 0 and quality_gbt.classify(docs, labels.limit(0)).count() == len(ROWS)


def test_trees_learn_and_repeat():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gbt.Boosted().fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    assert (quality_gbt.Boosted().fit(x[:1500], y[:1500]).score(x) == model.score(x)).all()


def test_tokens(docs, empty):
    import sentencepiece

    model = sentencepiece_codec.Pieces.load(TOKENIZER)
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model).collect()
    texts = dict(ROWS)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.decoded == (texts[r.doc_id] or "") and r.key == "k"
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(empty, model), model).count() == 0


def test_long_segments_and_odd_characters_match_the_library():
    import sentencepiece

    model, library = sentencepiece_codec.Pieces.load(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    r = random.Random(4)
    texts = ["x" * 5000, " " * 300, "a" * 64, "a" * 65, "\x00\x01", "\U0001f600\ufb01", "²..²", "tab\tq\r\n", "a\xa0b", None, ""] + ["".join(r.choice("ab the  \n²é漢.x1") for _ in range(r.randint(0, 150))) for _ in range(200)]
    ids, at = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "") for t in texts]
    assert model.decode(ids.astype(int), at) == [t or "" for t in texts]


def test_viterbi_is_the_best_segmentation():
    import itertools

    import numpy as np

    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba", "bb"]
    scores = np.array([0, -2.0, -1.5, -1.4, -2.1, -2.5, -2.2, -3.3, -2.7])
    model = sentencepiece_codec.Pieces("unigram", pieces, scores, np.array([True] + [False] * 8), None)
    texts = ["".join(t) for n in range(1, 7) for t in itertools.product("ab", repeat=n)]
    ids, at = model.encode(texts)

    def best(t):
        top = {0: 0.0}
        for e in range(1, len(t) + 1):
            top[e] = max((top[s] + scores[pieces.index(t[s:e])] for s in range(e) if t[s:e] in pieces[1:]), default=-1e9)
        return top[len(t)]

    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert "".join(pieces[i] for i in own) == "▁" + t
        assert abs(scores[own].sum() - best("▁" + t)) < 1e-9


def test_groups_of_tables_that_repeat(spark, monkeypatch):
    """Equal chunks of documents in several tasks stay apart."""
    from tidemark.llm import hashing

    monkeypatch.setattr(hashing, "CHUNK", 300)
    base = [(f"w{k} w{k + 1} w{k + 2} w{k + 3} w{k + 4} w{k + 5} w{k + 6} w{k + 7}") for k in range(0, 40, 4)]
    rows = [(n * 100 + k, t) for n in range(3) for k, t in enumerate(base)] + [(1000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()} == brute.groups(rows)


def test_model_files_say_what_they_are(tmp_path):
    """Files made by hand: field numbers and values of the format, nothing else."""
    from tidemark.llm.sentencepiece_codec import _model_kind

    def model(trainer=b"", normaliser=b"", pieces=b""):
        path = tmp_path / "m"
        path.write_bytes(pieces + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normaliser)]) + normaliser)
        return str(path)

    plain = b"\x20\x00"  # white space is not trimmed
    assert _model_kind(model(b"\x18\x02", plain)) == ("bpe", True) and _model_kind(model(b"", plain + b"\x18\x00")) == ("unigram", False)
    for refused in (model(b"\x18\x03", plain), model(b"\x18\x02"), model(b"\x18\x02", plain + b"\x12\x01x"), model(b"\x18\x02", plain, b"\x0a\x02\x18\x04"), model(b"\xc0\x01\x01", plain)):
        with pytest.raises(ValueError):
            _model_kind(refused)
    assert _model_kind(TOKENIZER)[0] == "bpe"


def test_split_search_and_traversal_against_plain_versions():
    import numpy as np

    r = np.random.default_rng(4)
    x, y = np.round(r.normal(size=(300, 3)), 1), r.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 0.3] = 1
    model = quality_gbt.Boosted(depth=3, n_trees=5, bins=16, least=10).fit(x, y)

    def walk(row):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(row) for row in x])
    # The first split is the best of all by a plain search over rows.
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(300, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + model.ridge)
    best = max((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) if 10 <= (x[:, j] <= c).sum() <= 290)
    first = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert np.isclose(score(first) + score(~first), best[0])


def test_scores_of_repeated_and_very_long_rows(spark):
    rows = [(1, "the word " * 30_000), (1, "the word " * 30_000), (2, "a"), (2, "b c d"), (None, None)]
    out = quality_gbt.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1 and [r.held_out for r in out if r.doc_id is None] == [False]
