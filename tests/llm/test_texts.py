"""Row-wise operators: tokenizers, packing, rules, PII, quality, scoring."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lineseek.llm import bpe, gam, lm, packing, pii, rules
from tests.llm.conftest import FOLD, WORD, text_of

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def fold(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_segment_tree_merges_equal_a_scan():
    rnd = random.Random(3)
    pairs = [(a, b) for a in range(9) for b in range(9) if rnd.random() < 0.5]
    rnd.shuffle(pairs)
    ranks = {p: (k, 4 + (p[0] * 7 + p[1]) % 5) for k, p in enumerate(pairs)}
    for _ in range(500):
        symbols = [rnd.randrange(4) for _ in range(rnd.randrange(12))]
        want = list(symbols)
        while True:
            found = [(ranks[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks]
            if not found:
                break
            _, i = min(found)
            want[i : i + 2] = [ranks[want[i], want[i + 1]][1]]
        assert bpe.merge(symbols, {a << 32 | b: k for (a, b), (k, _) in ranks.items()}, [m for _, m in ranks.values()]) == want


def test_encoders_equal_the_library_on_odd_texts():
    own, words = bpe.ByteBPE(BYTES), packing.Encoder(WORDS)
    first, second = library(BYTES), library(WORDS)
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "中", "'s", "'ll", "1", "23", "!", "<|endoftext|>", "<|startoftext|>", " ", "　", "̈", "e",
             "Σ", "İ", "😀", "\x1c", "\x85", "the", "\r\n", "‍", "½"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        ids = first.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ",".join(map(str, ids))
        assert own.decode(own.encode(text)) == first.decode(ids, skip_special_tokens=False)
        ids = second.encode(text, add_special_tokens=False).ids
        assert next(iter(words.encode([text]))) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_bpe_over_tables(documents, odd, none):
    texts, tokenizer = text_of(documents), library(BYTES)
    rows = bpe.digests(documents, BYTES).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r.doc_id is None:
            continue
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r.doc_id: r for r in bpe.encode(odd, BYTES).collect()}
    assert full[900001].ids == [] and full[900004].decoded == "a"
    assert bpe.digests(none, BYTES).count() == 0


def test_plan_is_gapless_and_tight():
    rnd = random.Random(2)
    for window in (7, 64, 300):
        for _ in range(30):
            counts = {rnd.randrange(1, window + 1): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 30))}
            room = Counter()
            for length, first, last, each, sequence, place in packing.plan(counts, window):
                for rank in range(first, last + 1):
                    s, nth = divmod(rank - first, each)
                    assert room[sequence + s] == place + nth * length  # placed behind what is there
                    room[sequence + s] += length
            total = sum(k * n for k, n in counts.items())
            assert sum(room.values()) == total and max(room.values()) <= window
            # best fit decreasing, piece by piece
            free = []
            for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
                fit = min((f for f in free if f >= length), default=None)
                if fit is None:
                    free.append(window - length)
                else:
                    free[free.index(fit)] -= length
            assert len(room) == len(free)


def test_packing_over_tables(spark, documents, odd, none):
    tokenizer = library(WORDS)
    rows = packing.pack(documents, WORDS, window=512, with_ids=True).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, text in text_of(documents.where("doc_id is not null and doc_id <> 900006")).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s : s + 512]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + 512]))) for k, s in enumerate(range(0, len(ids), 512))]
        assert sorted(pieces[doc]) == want
    assert len(pieces[900006]) == 2  # a repeated row is packed twice
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(places) <= 1.02 * total / 512 + 1
    whole = packing.sequences(packing.pack(odd, WORDS, window=64, with_ids=True)).collect()
    assert all(len(r.ids) <= 256 for r in whole)
    assert packing.pack(none, WORDS).count() == 0


def statistics(text):
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if count[run] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_and_verdicts(spark, documents, labels, none):
    texts = text_of(documents)
    rows = rules.judge(documents, labels).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r.doc_id is None:
            continue
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert rules.judge(none, labels).count() == 0
    unlabelled = rules.judge(documents, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in unlabelled)


def test_rules_find_thresholds(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        low = rnd.random() < 0.3
        rows.append((i, 100, 500 + (rnd.randrange(100)), rnd.randrange(60, 90) if low else rnd.randrange(0, 50), 0, 0, 0, 0 if low else 1, i % 3))
    table = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capital_runs long, y int, fold int")
    found = rules.learn(table)
    assert len(found) == 1 and found[0][0].test == "symbols_per_word" and 0.45 <= found[0][0].cut <= 0.6
    low = table.withColumn("rule", rules.verdict(found)).where("(rule is not null) <> (y = 0)").count()
    assert low <= len(rows) / rules.CUTS  # thresholds are quantiles: one step of them at most


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            luhn = sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


def test_personal_data(documents, none):
    # the plain e-mail pattern takes quadratic time on the longest runs
    some = documents.where("coalesce(doc_id, 0) not in (900008, 900011)")
    texts = text_of(some)
    rows = pii.extract(documents).collect()
    assert len(rows) == documents.count()
    learned = 0
    for r in rows:
        if r.doc_id not in texts or r.doc_id is None:
            continue
        spans = base_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        count = Counter(k for *_, k in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        own = [x for x in r.spans.split(",") if x]
        assert [x for x in own if not x.startswith("id:")] == [x for x in listed.split(",") if x]
        learned += len(own) - len(spans)
    assert pii.extract(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words here api_key: {hashlib.md5(str(i).encode()).hexdigest()} and version number_{i}x9 of it") for i in range(20)]
    rows += [(100 + i, f"other text api_key: short-{i}77 then version number_{i}x8") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.extract(df).collect()}
    assert all(got[100 + i].startswith("id:20:") and "," not in got[100 + i] for i in range(4))
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[101] == "other text api_key: [ID] then version number_1x8"


def test_redaction_keeps_the_rest(odd, none):
    before, after = text_of(odd), pii.redact(odd)
    assert after.columns == odd.columns
    after = text_of(after)
    assert after[900004] == "a" and after[900010] == before[900010]
    assert after[900012] == "[EMAIL][EMAIL], [EMAIL][EMAIL] mail: [EMAIL]. [PHONE]"
    assert pii.redact(none).count() == 0


def test_quality_learns_and_holds_out(spark, given, documents, labels, none):
    docs = spark.read.parquet(given.replace("0.001", "0.01") + "/documents.parquet")
    marks = spark.read.parquet(given.replace("0.001", "0.01") + "/labels.parquet")
    want = {r.doc_id: r.quality for r in marks.collect()}
    rows = [r for r in gam.classify(docs, marks, fold(3) == 1).collect() if r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(want[r.doc_id] == r.predicted for r in held) >= 0.97 * len(held)
    odd_rows = gam.classify(documents, labels, fold(3) == 1).collect()
    assert len(odd_rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd_rows)
    assert gam.classify(none, labels, fold(3) == 1).count() == 0
    assert {(r.score, r.predicted) for r in gam.classify(documents, labels.where("false"), fold(3) == 1).collect()} == {(0.5, 1)}
    kept = gam.accepted(documents, labels, fold(3) == 1)
    assert kept.columns == documents.columns and kept.count() == sum(r.predicted for r in odd_rows)


def test_pairs_carry_what_single_tables_cannot(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000], rounds=60)
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_scores_have_the_exact_base(documents, none):
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(FOLD)), None] for r in documents.where("doc_id is not null").collect()}
    count = Counter()
    for r in documents.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update([*WORD.findall((r.text or "").translate(FOLD)), None])
    total, distinct = sum(count.values()), len(count)
    for head in (1_000_000, 50):
        rows = lm.score(documents, fold(7) == 2, head=head).collect()
        assert len(rows) == documents.count()
        for r in rows:
            if r.doc_id is None:
                continue
            own = tokens[r.doc_id]
            base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score)
    assert lm.score(none, fold(7) == 2).count() == 0


def test_filter_counts_never_fall_short():
    import numpy as np

    keys, counts = lm.mix(np.arange(5000)), np.random.default_rng(1).zipf(1.5, 5000).clip(max=10_000)
    bits = 1 << 18
    bitmap = np.zeros(bits // 8, np.uint8)
    level = lm.levels(counts)
    for j in range(1, level.max() + 1):
        for place in lm.positions(keys[level >= j], j, bits):
            np.bitwise_or.at(bitmap, (place >> np.uint64(3)).astype(int), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    stored = lm.Filter(bitmap, 0, bits)
    got = stored.counts(keys)
    assert (got >= lm.typical()[level]).all() and (got == lm.typical()[level]).mean() > 0.98
    assert (stored.counts(lm.mix(np.arange(10_000, 20_000))) == 0).mean() > 0.95


def test_scores_do_not_depend_on_former_bounds(documents):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)
    want = sorted(lm.score(documents, fold(7) == 2).collect(), key=key)
    got = sorted(lm.score(documents, fold(7) == 2, filter_bytes=1).collect(), key=key)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], rel=1e-9)


def test_unseen_pairs_seldom_pass_in_any_block():
    import numpy as np

    for n in (100, 20_000, 2_000_000):
        seen = lm.mix(np.arange(n))
        full = lm.stored(seen, np.ones(n, np.int64))
        assert (full.counts(seen) >= 1).all() and (full.counts(lm.mix(np.arange(3_000_000, 3_100_000))) > 0).mean() < 0.03
