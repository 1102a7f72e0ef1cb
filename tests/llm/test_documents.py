"""Operators on documents against brute force, with nulls, empty and repeated texts and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tesserae.llm import line_dedup, ngram_join, packing, sentencepiece_codec, sharding, suffix_dedup, token_counts
from tesserae.llm.shingles import word_hashes
from tesserae.llm.tokens import ByteBpe, vocabulary

from .plain import corpus, frame, jaccard_components, shingles, suffix_rows, without_lines


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], 1)


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 8, 10)])
def test_ngram_join(docs, rows, words, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, words, num, den).collect()}
    assert got == jaccard_components(rows, words, num, den)


def test_ngram_join_repeated_ids(spark):
    """An id is one node: what its rows link to is one component, whatever the others are."""
    r = random.Random(1)
    text = lambda: [f"w{r.randrange(10_000)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near = lambda t: " ".join([*t[:30], "other", *t[31:]])
    rows = [(3, " ".join(a)), (5, near(a)), (5, " ".join(b)), (7, near(b)), (8, " ".join(c)), (8, ""), (8, None), (9, None), (None, " ".join(a)), (None, None), (11, " ".join(c)), (11, " ".join(c))]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in ngram_join.join(frame(spark, rows), 4, 85, 100).collect())
    assert got == sorted([(3, 57, 3), (5, 57, 3), (5, 57, 3), (7, 57, 3), (8, 57, 8), (8, 0, 8), (8, 0, 8), (9, 0, 9), (0, 57, 0), (0, 0, 0), (11, 57, 8), (11, 57, 8)])


def test_ngram_join_long_lists(spark, monkeypatch):
    """Posting lists above the all-pairs size, frequent tokens and several blocks lose no link."""
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    monkeypatch.setattr(ngram_join, "TIMES_ROOT", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = corpus(seed=8, n=90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, rows), 4, 85, 100).collect()}
    assert got == jaccard_components(rows, 4, 85, 100)


@pytest.mark.parametrize(("num", "most"), [(85, 60), (85, 700), (80, 12), (80, 300), (75, 80), (50, 40)])
def test_signatures_meet(num, most):
    """Any two sets that are similar enough share a signature, whatever tokens are frequent."""
    r = np.random.default_rng(num + most)
    met = 0
    for _ in range(400):
        n = int(r.integers(1, most))
        a = np.unique(r.integers(0, 1 << 40, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(r.integers(0, 1 + n * (100 - num) // 100))):
            b[r.integers(0, len(b))] = r.integers(0, 1 << 40)
        b = np.unique(b[: len(b) - int(r.integers(0, 3))] if len(b) > 4 else b)
        both = len(np.intersect1d(a, b))
        if len(b) and both * 100 >= num * (len(a) + len(b) - both):
            met += 1
            for r_share in (0, 1, 5, 10):
                counts = lambda s: np.where(s % np.uint64(10) < np.uint64(r_share), 9 + s % np.uint64(7), s % np.uint64(9))  # noqa: E731, B023
                x, y = (ngram_join.signatures(s, counts(s), 8.5, num, 100) for s in (a, b))
                assert len(np.intersect1d(x, y))
                assert len(x) <= 4 * n  # in proportion to the set
    assert met > 30


def test_ngram_join_common_token(spark):
    """Sets of 150 to 2,000 words with one shingle in all of them, and near copies of some; ids above 2^53 beside null ones."""
    r = random.Random(2)
    common, rows = "the same five words here", []
    for i in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randint(150, 2000))]
        rows.append(((1 << 53) + 2 * i + 1, common + " " + " ".join(w)))
        if i % 3 == 0:
            w[r.randrange(len(w))] = "other"
            rows.append(((1 << 53) + 2 * i + 2, " ".join(w) + " " + common))
    got = ngram_join.join(frame(spark, [*rows, (None, "a b c d e"), (None, rows[0][1])], 1), 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == jaccard_components(rows, 4, 85, 100)
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == sorted([2, len(shingles(rows[0][1], 4))])


def test_maximal_repeats_are_those_of_brute_force():
    """Each group's strings are equal, no longer in common, and not all extensible to the left; all repeats are there."""
    r = random.Random(3)
    for _ in range(60):
        pieces = list(dict.fromkeys("".join(r.choice("ab") for _ in range(r.randint(4, 14))).encode() for _ in range(r.randint(1, 6))))
        got = suffix_dedup.maximal_repeats(pieces, [1] * len(pieces), 4)
        info = {g: (up, size) for g, up, size, *_ in got}
        members: dict = defaultdict(set)
        for g, _, _, own, offset in got:
            while g >= 0 and own >= 0:
                members[g].add((own, offset))
                g = info[g][0]
        places = [(i, a) for i, p in enumerate(pieces) for a in range(len(p) - 3)]
        want = set()
        for i, a in places:
            for size in range(4, len(pieces[i]) - a + 1):
                same = frozenset((j, b) for j, b in places if pieces[j][b : b + size] == pieces[i][a : a + size])
                left = {pieces[j][b - 1] if b else -1 - j for j, b in same}
                right = {pieces[j][b + size] if b + size < len(pieces[j]) else -1 - j for j, b in same}
                if len(same) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((size, same))
        assert {(info[g][1], frozenset(m)) for g, m in members.items()} == want


def test_repeat_groups(spark, docs, rows):
    """Strings of a group are equal; each repeated window of a text lies in a group at every place that has it."""
    got = suffix_dedup.repeat_groups(docs, 100).collect()
    text = {i: (t or "").encode() for i, t in rows}
    strings, covered = defaultdict(set), defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            part = text[r.doc_id][r.start : r.start + r["size"]]
            assert len(part) == r["size"] >= 100
            strings[r.key, r.group].add(part)
            covered[r.doc_id].update(range(r.start, r.start + r["size"] - 99))
    assert all(len(s) == 1 for s in strings.values())
    seen = defaultdict(list)
    for i, t in text.items():
        for a in range(len(t) - 99):
            seen[t[a : a + 100]].append((i, a))
    assert all(a in covered[i] for places in seen.values() if len(places) > 1 for i, a in places)


def test_long_regular_runs_differ():
    """Two texts of 300 bytes whose sums of bytes nearly agree for any odd factor."""
    text = "a"
    while len(text) < 512:
        text += text.translate(str.maketrans("ab", "ba"))
    a, b = (np.frombuffer(t[:300].encode(), np.uint8) for t in (text, text.translate(str.maketrans("ab", "ba"))))
    x, y = (suffix_dedup.runs(t, 300)[1] for t in (a, b))
    assert len(x) == len(y) == 1
    assert (x ^ y)[0] % (1 << 16)


def test_long_regular_words_differ():
    """Two words whose sums of bytes agree for any odd factor."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    hashes, _ = word_hashes([word, word.translate(str.maketrans("ab", "ba"))])
    assert hashes[0] != hashes[1]


def test_sharding(docs, rows):
    got = sharding.shard(docs, 16).collect()
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(text)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
        shards[data].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())


def test_schedule_is_even():
    sizes = list(range(1, 400))
    placed = sharding.schedule(list(enumerate(sizes)), 16)
    load = [sum(sizes[k] for k, s in placed.items() if s == j) for j in range(16)]
    assert max(load) - min(load) <= 16  # the items of a round differ by at most this


def test_packing(docs, rows):
    got = packing.pack(docs, 2048).collect()
    codec, ids = ByteBpe(), {}
    for i, t in rows:
        ids[i] = [*codec.full.encode(t or "", add_special_tokens=False).ids, 1]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        pieces[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length, p.sequence_tokens))
    for own in (*pieces.values(), *(((o, n) for o, n, _ in s) for s in sequences.values())):
        end = 0
        for start, length in sorted(own):
            assert start == end
            assert length > 0
            end = start + length
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    for s in sequences.values():
        total = sum(n for _, n, _ in s)
        assert total == s[0][2] <= 2048
        assert total & (total - 1) == 0  # no sequence needs padding


def test_packing_plan_balances_cost():
    lengths = np.random.default_rng(2).integers(1, 5000, 2000).tolist()
    pieces = packing.plan(lengths, 2048)
    load = defaultdict(float)
    size = defaultdict(int)
    for _, _, n, s, _ in pieces:
        load[s] += packing.cost(n, 2048)
        size[s] += n
    full = [load[s] for s, n in size.items() if n == 2048 and load[s] < packing.cost(2048, 2048)]
    assert np.std(full) < 0.25 * np.mean(full)
    assert sum(size.values()) == sum(lengths)


def test_packing_plan_takes_the_cheapest_with_room():
    """Each remainder goes to the sequence of least cost that has room for it, found by trying all."""
    lengths, limit = np.random.default_rng(5).integers(1, 200, 300).tolist(), 64
    total = sum(n % limit for n in lengths)
    sizes = [limit] * (total // limit) + [1 << b for b in range(7) if total % limit >> b & 1]
    load, filled, want, first = [0.0] * len(sizes), [0] * len(sizes), [], sum(n // limit for n in lengths)
    rest = sorted(((n % limit, d, n - n % limit) for d, n in enumerate(lengths) if n % limit), key=lambda r: (-packing.cost(r[0], limit), r[1]))
    for n, d, at in rest:
        while n:
            room = [i for i in range(len(sizes)) if sizes[i] - filled[i] >= n] or [i for i in range(len(sizes)) if sizes[i] > filled[i]]
            i = min(room, key=lambda i: (load[i], i))
            take = min(n, sizes[i] - filled[i])
            want.append((d, at, take, first + i, filled[i]))
            load[i], filled[i], n, at = load[i] + packing.cost(take, limit), filled[i] + take, n - take, at + take
    got = packing.plan(lengths, limit)
    assert sorted(p for p in got if p[2] < limit or p[3] >= first) == sorted(want)


def test_byte_bpe_is_the_librarys(rows):
    codec = ByteBpe()
    odd = ["<|endoftext|> a", "a  b \n c", "日本 text", "x y", "don't  we'll", "\x00\x01", "é", " lead", "tail ", "\t\n "]
    for t in [*(t or "" for _, t in rows), *odd, "".join(map(chr, range(0x20, 0x250)))]:
        assert codec.ids(t).tolist() == codec.full.encode(t, add_special_tokens=False).ids


def test_token_counts(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    odd = [(900, "<|endoftext|>x"), (901, "İstanbul é"), (902, "a b 日本"), (903, "don't"), (904, "word " * 3000)]
    cache = f"file://{tmp_path}/cache"
    more = frame(spark, [*rows, *odd])
    for table, own in ((docs, rows), (more, [*rows, *odd])):  # the second finds most in the cache
        got = {r.doc_id: r[1:] for r in token_counts.count_tokens(table, cache).collect()}
        for i, t in own:
            n = len(full.encode(t or "", add_special_tokens=False).ids)
            assert got[i] == (len((t or "").encode()), n, n > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest", "tokenizer").distinct().count() == len({t or "" for _, t in [*rows, *odd]})


def test_suffix_dedup(docs, rows):
    for length in (100, 40):
        got = {r.doc_id: r[1:] for r in suffix_dedup.dedup(docs, length).collect()}
        assert got == suffix_rows(rows, length)


def test_suffix_dedup_hot_fingerprints(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 2)
    monkeypatch.setattr(suffix_dedup, "MANY_PIECES", 1)
    assert {r.doc_id: r[1:] for r in suffix_dedup.dedup(docs, 100).collect()} == suffix_rows(rows, 100)


def test_suffix_dedup_giant_text(monkeypatch):
    """A text that is fingerprinted in parts has the runs of the whole."""
    data = np.frombuffer(b"".join(str(i).encode() * 3 for i in range(2000)), np.uint8)
    h, content, at, n, more = suffix_dedup.runs(data, 100)
    assert at[0] == 0
    assert (at[1:] == (at + n)[:-1]).all()
    assert at[-1] + n[-1] == len(data) - 99


def _shared_at_lengths(seed: int):
    """Pieces that share the start of one passage at lengths of 129 to 600 bytes, and passages with a recurring stretch, some cut before NULs."""
    r = np.random.default_rng(seed)
    letters = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    passage, stretch = letters(611), letters(40)
    pieces = [letters(int(r.integers(0, 4))) + passage[: int(r.integers(129, 166))] + letters(2) for _ in range(4)]
    again = (stretch + letters(30)) * 8
    pieces += [letters(int(r.integers(0, 3))) + again[: int(r.integers(200, 520))] + letters(3) for _ in range(4)]
    pieces += [passage[:150] + b"\0" * int(r.integers(0, 4)) for _ in range(3)]
    return [pieces[i] for i in r.permutation(len(pieces))]


def _covered(pieces, length: int):
    seen, gone = set(), []
    for p in pieces:
        own = np.zeros(len(p), bool)
        for s in range(len(p) - length + 1):
            own[s : s + length] |= p[s : s + length] in seen
            seen.add(p[s : s + length])
        gone.append(own.tolist())
    return gone


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_is_exact_over_whole_pieces(seed):
    """Common prefixes beyond 128 and 255 bytes lose no window, at different lengths and with recurring stretches."""
    pieces = _shared_at_lengths(seed)
    docs, starts, ends = suffix_dedup.repeats(pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64), 100)
    got = [np.zeros(len(p), bool) for p in pieces]
    for d, s, e in zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True):
        got[d][s:e] = True
    assert [g.tolist() for g in got] == _covered(pieces, 100)


def test_suffix_dedup_at_different_lengths(spark):
    """The operator on whole documents that share a passage at different lengths."""
    rows = [(k * 100 + i, p.decode()) for k in range(5) for i, p in enumerate(_shared_at_lengths(k))]
    assert {r.doc_id: r[1:] for r in suffix_dedup.dedup(frame(spark, rows), 100).collect()} == suffix_rows(rows, 100)


def test_suffix_dedup_keeps_whole_characters(spark):
    """A repeat that begins inside a character leaves the character."""
    shared = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    first, second = "é" + shared, "ũ" + shared + "!"
    assert first.encode()[1] == second.encode()[1]
    got = suffix_dedup.dedup(frame(spark, [(1, first), (2, second)]), 100, keep_text=True, carry=("lang",)).collect()
    assert {r.doc_id: (r.text, r.lang) for r in got} == {1: (first, "en"), 2: ("ũ!", "en")}


def test_united_spans():
    """Against the plain merge of each document's spans."""
    import pandas as pd

    r = np.random.default_rng(1)
    for _ in range(100):
        n = int(r.integers(1, 40))
        doc, start = r.integers(-3, 4, n), r.integers(0, 60, n)
        end = start + r.integers(1, 12, n)
        got = sorted(map(tuple, suffix_dedup.united(pd.DataFrame({"doc": doc, "start": start, "end": end})).itertuples(index=False)))
        assert got == sorted((int(k), a, b) for k in set(doc.tolist()) for a, b in suffix_dedup.merged(start[doc == k], end[doc == k]))


def test_longest_earlier():
    """Against all pairs: the longest prefix shared with an older entry of the interval."""
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(2, 12))
        age, common = r.permutation(n).tolist(), r.integers(1, 9, n).tolist()
        want = [max([min(common[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if age[j] < age[i]], default=0) for i in range(n)]
        assert suffix_dedup.longest_earlier(age, common) == want


def test_line_dedup(docs, rows):
    for run in (3, 4):
        got = {r.doc_id: r[1:] for r in line_dedup.dedup(docs, run).collect()}
        assert got == without_lines(rows, run)


def _library():
    import sentencepiece as sp

    return sp.SentencePieceProcessor(model_proto=sentencepiece_codec.unigram(vocabulary("piece_bpe_32k.model")))


def test_sentencepiece(spark, docs, rows):
    """Ids are the library's for the same unigram model; texts without spaces, with many, and with unknown characters are split too."""
    model, r = _library(), random.Random(6)
    odd = [(1000, "".join(r.choice("abcdefgh") for _ in range(900))), (1001, " " * 500 + "x" + " " * 450), (1002, "日本語テキスト😀" * 60), (1003, "a▁b " * 90), (1004, "the end " * 100), (1005, "\n\t " * 200)]
    got = {x.doc_id: x for x in sentencepiece_codec.encode_documents(docs.unionByName(frame(spark, odd)), chunk=100).collect()}
    assert sum(x.n_chunks > 1 for x in got.values()) > 20
    for i, t in [*rows, *odd]:
        ids = model.encode(t or "")
        assert got[i].ids == ids
        assert (got[i].n_bytes, got[i].n_tokens, got[i].ids_crc32, got[i].round_trip) == (len((t or "").encode()), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), i != 1003)


def test_sentencepiece_as_its_file_has_it(docs, rows):
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in sentencepiece_codec.encode_documents(docs, chunk=100, as_unigram=False).collect()}
    assert got == {i: model.encode(t or "") for i, t in rows}


def test_scan_over_blocks_of_chunks(spark, monkeypatch):
    """Matrices of many blocks combine to the same path; null ids beside ids above 2^53 stay as they are."""
    model, r = _library(), random.Random(8)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 3)
    big = (1 << 53) + 1
    texts = [(big, " ".join("".join(r.choice("etaoinsh") for _ in range(r.choice([1, 3, 90]))) for _ in range(120))), (None, "x" * 2000), (None, "short")]
    got = sorted(((x.doc_id, x.ids) for x in sentencepiece_codec.encode_documents(frame(spark, texts, 1), chunk=60).collect()), key=str)
    assert got == sorted(((i, model.encode(t)) for i, t in texts), key=str)


def test_packed_sequences_hold_the_ids(docs, rows):
    """The pieces of a document put together are its ids; the pieces of a sequence fill it."""
    codec, found, filled = ByteBpe(), defaultdict(dict), defaultdict(dict)
    for p in packing.pack(docs, 64).collect():
        assert len(p.ids) == p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        found[p.doc_id][p.start] = p.ids
        filled[p.sequence_id][p.offset] = p.ids, p.sequence_tokens
    for i, t in rows:
        assert sum((found[i][k] for k in sorted(found[i])), []) == [*codec.full.encode(t or "", add_special_tokens=False).ids, 1]
    for s in filled.values():
        assert sum(len(ids) for ids, _ in s.values()) == next(iter(s.values()))[1]


def test_sentencepiece_ids_and_their_texts(spark, docs, rows, tmp_path):
    """Ids are the library's and come back as texts when they were stored, split texts included."""
    model = _library()
    sentencepiece_codec.encode_documents(docs, chunk=100).write.parquet(f"file://{tmp_path}/ids")
    stored = spark.read.parquet(f"file://{tmp_path}/ids")
    texts = {i: t or "" for i, t in rows}
    assert {r.doc_id: (r.ids, r.decoded) for r in stored.collect()} == {i: (model.encode(t), t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode_documents(stored).collect()} == texts
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5, None]), (4, [1 << 30]), (5, [-1]), (None, [70]), (None, [70])], "doc_id bigint, ids array<int>")
    got = sorted(((r.doc_id, r.text) for r in sentencepiece_codec.decode_documents(odd).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, None), (4, None), (5, None), *[(None, model.decode([70]))] * 2], key=str)
    assert sentencepiece_codec.decode_documents(stored.limit(0)).count() == 0


def test_unigram_scan(tmp_path):
    """The max-plus scan over chunks gives the library's ids for a unigram model."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3.1, 1), ("a", -2.2, 1), ("b", -2.3, 1), ("c", -2.7, 1), ("ab", -3.3, 1), ("▁a", -2.9, 1), ("bc", -3.45, 1), ("abc", -4.1, 1), ("cab", -4.33, 1), ("▁ab", -3.6, 1), ("bca", -5.07, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    path = tmp_path / "toy.model"
    path.write_bytes(m.SerializeToString())
    c, lib = sentencepiece_codec.Codec(str(path)), sp.SentencePieceProcessor(model_file=str(path))
    r = np.random.default_rng(4)
    for n in (0, 1, 3, 10, 60, 200):
        text = "".join(r.choice(list("abc "), n))
        want = lib.encode(text)
        for chunk in (3, 7, 1000):
            assert sentencepiece_codec.scanned(c, text, chunk) == want
    a, b, d = (r.integers(-9, 0, (4, 4)).astype(float) for _ in range(3))
    left, right = (sentencepiece_codec.combine(sentencepiece_codec.combine(a, b), d), sentencepiece_codec.combine(a, sentencepiece_codec.combine(b, d)))
    assert (left == right).all()


def test_empty_tables(empty):
    for out in (ngram_join.join(empty), sharding.shard(empty), packing.pack(empty), token_counts.count_tokens(empty),
                suffix_dedup.dedup(empty), line_dedup.dedup(empty), sentencepiece_codec.encode_documents(empty)):
        assert out.count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = frame(spark, [(None, "some words that are here"), (None, None), (4, "some words that are here"), (4, "some words that are here")])
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(docs).collect()), key=str)
    assert got == [(4, 4), (4, 4), (None, None), (None, None)]
    assert suffix_dedup.dedup(docs).count() == 4
    assert line_dedup.dedup(docs).count() == 4
    assert sharding.shard(docs).count() == 4
    assert token_counts.count_tokens(docs).count() == 4
    assert sentencepiece_codec.encode_documents(docs).count() == 4
    assert sum(r.length for r in packing.pack(docs).collect() if r.doc_id == 4) == 2 * packing.pack(docs).where("doc_id = 4").first().doc_tokens


@pytest.mark.parametrize("partitions", [1, 5])
def test_repeated_and_null_ids_of_long_texts(spark, partitions):
    """Each row is a document of its own: rows of one id in the order of their texts, rows of null ids last."""
    lines = [f"line {i} of some text that goes on for {i * i} words" for i in range(60)]
    texts = ["\n".join(lines[a:b]) for a, b in ((0, 12), (0, 12), (8, 30), (25, 50), (40, 60), (50, 60), (0, 9))]
    rows = list(zip([7, 7, 7, 3, None, None, None], texts, strict=True))
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    docs = frame(spark, rows, partitions)
    want = sorted(((i, *x) for (i, _), x in zip(ordered, suffix_rows(enumerate(t for _, t in ordered), 100).values(), strict=True)), key=str)
    assert sorted((tuple(r) for r in suffix_dedup.dedup(docs, 100).collect()), key=str) == want
    want = sorted(((i, *x) for (i, _), x in zip(ordered, without_lines(enumerate(t for _, t in ordered), 3).values(), strict=True)), key=str)
    got = line_dedup.dedup(docs, 3, carry=("lang",)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert {r.lang for r in got} == {"en"}
