"""Corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from binwright.llm import chat, decontaminate, exact_dedup, jaccard, langid, line_dedup, pieces, pii, quality, token_files

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
# Columns whose names the operators also use inside.
SCHEMA = "doc_id long, text string, lang string, digest string, row_key string, id string, n string, score string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "d", "r", "i", "n", "s") for i, t in rows], SCHEMA)


LONG = prose(1, 30_000)
EDGE = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "a\n\nb"), (6, "x  y\t z"), (7, "x y z"), (7, "x y z"), (8, "x y z"), (None, "x y z"),
    (None, None), (9, "é日本𐍈 naïve"), (10, LONG), (11, LONG), (12, prose(2, 60)), (13, prose(2, 60) + "."),
]


def test_exact_dedup_is_brute_force(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup_report(docs(spark, EDGE)).collect()), key=str)
    groups = {}
    for i, t in EDGE:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    want = []
    for i, t in EDGE:
        norm = SPACE.sub(" ", t or "")
        keep = min((x for x in groups[norm] if x is not None), default=None)
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_compares_content_when_digests_collide(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(900)]
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 10)  # every digest is hot, so all three stages run
    for digest in (exact_dedup.sha256, lambda c: F.unhex(F.lit("00"))):
        out = exact_dedup.exact_dedup(docs(spark, rows).repartition(8), digest)
        assert {(r.doc_id, r.keep_id, r.kept) for r in out.collect()} == {(i, i % 7, i < 7) for i in range(900)}


def test_empty_tables_give_no_rows(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for frame in (
        exact_dedup.exact_dedup_report(none), line_dedup.line_dedup_report(none), quality.quality_report(none, labels),
        langid.language_report(none), token_files.token_files_report(none, BPE), jaccard.jaccard_components(none),
        pii.find_personal_data(none), decontaminate.contaminated(none, items), pieces.pieces_report(none, PIECES),
        chat.read_back(chat.format_conversations(talks)),
    ):
        assert frame.count() == 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(3)
    base = [prose(s, 6) for s in range(12)] + ["short", "shore", "", "  "]
    texts = []
    for _ in range(60):
        lines = []
        for line in rng.choices(base, k=4):
            p = rng.randrange(len(line)) if line else 0
            lines.append(rng.choice([line, line, line[:p] + "Z" + line[p:], line[:p] + line[p + 1:], line[:p] + "é" + line[p + 1:], f"  {line}\t"]))
        texts.append("\n".join(lines))
    rows = [*enumerate(texts), (100, None), (101, ""), (None, base[0])]
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    seen, want = [], {}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        kept = []
        for line in (t or "").split("\n"):
            norm = SPACE.sub(" ", line).strip(" ")
            repeated = any(norm == s or (min(len(norm), len(s)) >= 20 and within_one(norm, s)) for s in seen)
            if not norm or not repeated:
                kept.append(line)
            if norm:
                seen.append(norm)
        want[i] = "\n".join(kept)
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.digest == "d" and r.n_lines >= r.n_kept_lines for r in out.values())


def bags():
    rows, labels = [], []
    for i in range(400):
        text = prose(i, 80)
        bad = i % 4 == 1
        rows.append((i, " ".join(w + "&&&" for w in text.split()) if bad else text))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_learns_and_keeps_columns(spark):
    rows, labels = bags()
    rows += [(1000, None), (1001, ""), (None, prose(5, 50)), (1002, LONG), (1003, "é")]
    marked = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality_report(docs(spark, rows), marked).collect()}
    assert len(out) == len(rows) and out[1000].score == out[1001].score == 0 and out[1002].predicted == 1
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert {i for i, r in out.items() if r.held_out} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(p == y for p, y in held) >= 0.98 * len(held)
    assert set(quality.keep_good(docs(spark, rows), marked).columns) == set(SCHEMA.replace(",", "").split()[::2])
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_report(docs(spark, [(1, "a"), (2, None)]), nothing).collect()} == {0.5, 0.0}


def test_quality_learns_from_one_row_of_a_repeated_id(spark, monkeypatch):
    rows, labels = bags()
    rows += [(4, prose(9000 + i, 80)) for i in range(200)]
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda b, y: seen.append([x.tobytes() for x in b]) or fit(b, y, steps=1))
    for part in (3, 7):  # the row does not depend on the partitions
        quality.learn_quality(docs(spark, rows).repartition(part), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in labels) and seen[0] == seen[1]


def test_attention_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    x = [rng.normal(size=(n, quality.N_FEATURES)).astype(np.float32) for n in (1, 3, 2, 4)]
    labels = np.array([1, 0, 1, 0])
    loss = lambda m: -np.mean(np.log(np.where(labels == 1, m.score(x), 1 - m.score(x))))
    before = loss(quality.fit(x, labels, steps=1))
    assert loss(quality.fit(x, labels, steps=60)) < before / 3


def test_language(spark):
    speak = {"aa": "bada gado bodu dagu", "zz": "ksit prits lek strik"}
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choice(speak[k].split()) for _ in range(80))
    rows = [(i, text(k), k) for i, k in enumerate(["aa", "zz"] * 60)]
    rows += [(500, None, None), (501, "12 !!", "aa"), (None, text("aa"), None), (502, text("zz") * 300, None), (503, text("aa"), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.language_report(table).collect()}
    assert (out[500].lang_pred, out[501].lang_pred, out[500].score) == ("und", "und", 0.0)
    assert out[502].lang_pred == "zz" and out[503].lang_pred == "aa" and out[None].lang_pred == "aa"
    assert all(out[i].lang_pred == k for i, _, k in rows[:120]) and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in langid.language_report(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_token_files_are_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = random.Random(4)
    odd = ["".join(rng.choice("ab 1\n\té日'.<|endoftext|> ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [*EDGE, (50, "a<|endoftext|>b <|endoftext|> c"), *((100 + i, t) for i, t in enumerate(odd))]
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files_report(docs(spark, rows).repartition(5), BPE).collect()))
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        want.append((i is not None, i or 0, start, len(ids), crc))
        start += len(ids)
    assert got == want


def test_chunks_are_looked_up_once(monkeypatch):
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return dict.get(self, key, default)

        def __getitem__(self, key):
            Counted.looked += 1
            return dict.__getitem__(self, key)

        def __contains__(self, key):
            Counted.looked += 1
            return dict.__contains__(self, key)

    from tokenizers import Tokenizer

    texts = ["the word, the naïve wörd. Łódź end!", "a\nb the word,", "", "日本 the"]
    code, library = token_files.ChunkEncoder(BPE), Tokenizer.from_file(BPE)
    code.known = Counted()
    want = [np.array(library.encode(t, add_special_tokens=False).ids, code.dtype).tobytes() for t in texts]
    assert code.encode(texts) == want
    Counted.looked = 0
    assert code.encode(texts) == want and Counted.looked == sum(len(token_files._keys(t)) for t in texts)
    monkeypatch.setattr(token_files, "CACHED_CHUNKS", 3)  # emptied at every call with new chunks
    for t, w in zip([*texts, "more words, the", *texts], [*want, None, *want], strict=True):
        assert code.encode([t]) == [w] or w is None
    assert code.encode([*texts, "other new words, the"])[:4] == want


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<\\s>", "<<SYS>>\\\\", "[", "<", "</", "a\nb", "", None, "<\\\\/s>[\\INST]", "[ROLE]x[/ROLE]", " [/INST", "<<</SYS>>"]
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", None, "[/ROLE]"]), rng.choice(tricky)))
    rows += [(None, 0, "user", "hi"), (99, None, "user", "a"), (99, 0, "assistant", "b"), (99, 0, "assistant", "b"), (100, 0, "user", "x " * 60_000), (100, 1, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit("clash"))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for conv, r in out.items():
        turns = sorted(((t, role, text or "") for c, t, role, text in rows if c == conv), key=lambda x: (none_first(x[0]), x[1] is not None, x[1] or "", x[2]))
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[1] or ''}\n{x[2]}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[100].valid and not out[99].valid and out[None].valid


def test_chat_order():
    order = chat.INSTRUCT.order
    assert "assistant" not in order[None] and order["user"] == ("assistant",)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_jaccard_is_brute_force(spark, monkeypatch):
    rng, rows = random.Random(8), [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "one"), (6, LONG), (7, LONG + " more")]
    for base in range(6):
        words = prose(base + 50, 120).split()
        for copy in range(40):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(120)] = f"new{rng.randint(0, 5)}"
            rows.append((100 + 40 * base + copy, " ".join(changed)))
    rows += [(900 + i, prose(900 + i, 60) + " " + prose(77, 40)) for i in range(20)]
    rng.shuffle(rows)
    want = sorted(brute_components(rows))
    for near in (64, 1):  # with almost no neighbours, the pairs between components must find the rest
        monkeypatch.setattr(jaccard, "NEAR", near)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows).repartition(6)).collect())
        assert got == want


def test_linked_sets_share_a_part_key():
    rng = np.random.default_rng(3)
    for percent in (90, 80):
        for n in [*range(1, 60), 200, 401, 1500]:
            for m in {n, max(n, n + (100 * n // percent - n) // 2), 100 * n // percent}:
                least = -(-percent * (n + m) // (100 + percent))
                for _ in range(8):  # as few common elements as a link may have
                    both, x, y = np.split(rng.integers(0, 2**64, n + m - least, np.uint64), [least, n])
                    keys = [jaccard.part_keys(np.sort(np.concatenate((both, z))), percent) for z in (x, y)]
                    assert np.intersect1d(*keys).size, (percent, n, m)


def test_sets_that_share_few_elements_share_hardly_a_part_key():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**64, 300, np.uint64)
    keys = [jaccard.part_keys(np.sort(np.concatenate((common, rng.integers(0, 2**64, 700, np.uint64)))), 90) for _ in range(40)]
    assert 1000 * (np.unique(np.concatenate(keys), return_counts=True)[1] > 1).sum() < sum(map(len, keys))


def test_near_pairs_count_bits_of_negative_numbers():
    n, none = np.array([40]), np.zeros((1, 4), np.int64)
    assert jaccard.may_link(n, none, n, np.array([[-(2**63), 0, 0, 0]]), 90)[0]
    assert not jaccard.may_link(n, none, n, np.array([[-1, 0, 0, 0]]), 90)[0]  # 64 bits differ; the absolute value has one


def test_ties_are_as_few_as_entries(spark):
    from binwright.llm.blocks import in_blocks

    # 300 sets of one list, each its own component: 44,850 pairs may link
    entries = spark.range(300).selectExpr("1L AS key", "id", "100L AS n", *[f"0L AS {c}" for c in jaccard.BITS])
    comps = spark.createDataFrame([], "id long, comp long")
    for block in (1000, 40):
        copies = in_blocks(entries, comps, ("n", *jaccard.BITS), block)
        groups = copies.select("p", "q").distinct().count()
        tied = [tuple(r) for r in jaccard.ties(copies, 90).collect()]
        assert len(tied) < copies.count() <= 300 * groups
        whole = jaccard.components(spark.createDataFrame(tied, "a long, b long")).collect()
        assert len(whole) == 300 and {r.comp for r in whole} == {0}


def test_jaccard_repeated_and_null_ids(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (None, prose(3, 50)), (None, prose(1, 50)), (7, prose(3, 50)), (None, prose(9, 50))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 48, 1), (1, 48, 1), (None, 48, 7), (None, 48, 1), (7, 48, 7), (None, 48, None)], key=str)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda: 9 <= len(digits) <= 15,
                "card": lambda: 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0,
            }
            if checks[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_base_is_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "@", ".", "1", "25", "+", " ", "-", "(", "4111111111111111", "x.y", "\n", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["1." * 30_000, "1" * 50_000, "a" * 50_000 + "@b.c", "+1" + " " * 50_000]
    rows = [*enumerate(texts), (2000, None), (None, "a@b.c"), (2001, "a@b.c"), (2001, "a@b.c")]
    out = pii.find_personal_data(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    base = {(i, hashlib.sha256(brute_spans(t or "").encode()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.base_sha256) for r in out} == base


def test_personal_data_discovers_by_context(spark):
    rows = [(i, f"word{i} please call me +1 (415) 555-{1000 + i} tomorrow") for i in range(40)]
    rows += [(100, "please call me (415) 555-7777 tomorrow"), (101, "the part (415) 555-7777x is old"), (102, "serial no 415-555-1234 ends")]
    out = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert (out[100].n_discovered, out[100].spans, out[100].n_phone) == (1, "phone:15:29", 0)
    assert out[102].n_discovered == 0 and out[1].spans == f"phone:{rows[1][1].index('+')}:{rows[1][1].index(' tomorrow')}"


def test_decontaminate(spark):
    items = [(i, " ".join(f"w{i}x{k}" if k % 3 else "the" for k in range(30 + i))) for i in range(8)] + [(50, None), (51, ""), (52, "tiny item")]
    rows = [(i, prose(i, 200)) for i in range(40)]
    exact = [(100 + i, f"{prose(300 + i, 70 + i)} {t} {prose(400 + i, 90)}") for i, t in items[:4]]
    para = []
    for i, t in items[4:8]:
        words = t.split()
        words[2], words[11:12] = "changed", ["and", "then"]
        para.append((200 + i, f"{prose(500 + i, 33)} {' '.join(words).upper()}, {prose(600 + i, 20)}"))
    half = [(300, prose(7, 80) + " " + " ".join(items[0][1].split()[:10]))]
    rows += [*exact, *para, *half, (400, None), (401, ""), (None, items[1][1]), (402, "the"), (403, LONG + " " + items[2][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()}
    assert got == {(100 + i, i) for i in range(4)} | {(200 + i, i) for i in range(4, 8)} | {(None, 1), (403, 2)}
    left = decontaminate.drop_contaminated(docs(spark, rows), table)
    assert left.count() == len(rows) - len(got) and left.columns == docs(spark, []).columns


def test_decontaminate_retrieves_by_the_latent_cosine_alone(spark, monkeypatch):
    # The paraphrases keep 46 of 60 words in order, but only 2 of 16 features: a plain TF-IDF cosine is below 0.5.
    items = [(i, " ".join(f"i{i}w{k:02}" for k in range(60))) for i in range(4)]
    para = [(5000 + i, " ".join("other" if w[3:] < "14" else w for w in t.split())) for i, t in items]
    rows = [(i, prose(i, 20)) for i in range(1200)] + para
    basis = decontaminate.latent_basis
    monkeypatch.setattr(decontaminate, "latent_basis", lambda *a: basis(*a, rank=4))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(5000 + i, i) for i in range(4)}


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 20))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate.place_bits(a), b, len(a)) == plain(a, b)


def test_pieces_are_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(10)
    odd = ["".join(rng.choice("ab é日\U00010348  ▁\n\t<s>ﬁ\0") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [*EDGE, *((100 + i, t) for i, t in enumerate(odd))]
    got = sorted(map(tuple, pieces.pieces_report(docs(spark, rows), PIECES).collect()), key=str)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hexed(",".join(map(str, ids))), hexed(library.decode(ids) if ids else ""), len((t or "").encode())))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
def test_pieces_with_a_character_map(rule, trim):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(PIECES, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    spec = proto.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    codec = pieces.PieceCodec(model.SerializeToString())
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab é日  ▁\n\tﬁＡ①É​́ﾊﾟ") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    for text, (ids, starts, ends, _) in zip(texts, codec.encode(texts)):
        want = codec.whole.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want]
        assert (starts.tolist(), ends.tolist()) == ([p.begin for p in want], [p.end for p in want])


def test_encode_then_decode_keeps_columns(spark):
    table = docs(spark, [(1, "one two"), (2, None)])
    out = {r.doc_id: r for r in pieces.decode_pieces(pieces.encode_pieces(table, PIECES), PIECES).collect()}
    assert out[1].decoded == "one two" and out[2].decoded == "" and out[1].digest == "d" and out[1].ends[-1] == 7
    with pytest.raises(ValueError):
        pieces.encode_pieces(table.withColumn("ids", F.lit(1)), PIECES)


def test_long_sets_that_share_few_elements_are_not_tied(spark):
    from binwright.llm.blocks import in_blocks

    # 40 sets of one list with 2,000 elements, 300 of them common; two more differ from the first by 200 each way
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.concatenate((common, rng.integers(0, 2**64, 1700, np.uint64))) for _ in range(40)]
    sets += [np.concatenate((sets[0][:1800], rng.integers(0, 2**64, more, np.uint64))) for more in (200, 249)]
    rows = [(1, i, len(s), *jaccard.short_bitmap(s), jaccard.bitmap(s)) for i, s in enumerate(sets)]
    entries = spark.createDataFrame(rows, f"key long, id long, n long, {', '.join(f'{c} long' for c in jaccard.BITS)}, bits binary")
    comps = spark.createDataFrame([], "id long, comp long")
    for block in (256, 8):
        copies = in_blocks(entries, comps, ("n", *jaccard.BITS, "bits"), block)
        tied = {tuple(r) for r in jaccard.ties(copies, 80).collect()}
        assert tied and {i for pair in tied for i in pair} == {0, 40, 41}


def test_bitmaps_of_any_length_never_part_linked_sets():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 700, 60)
    base = rng.integers(0, 2**64, 900, np.uint64)
    sets = [base[:n] for n in sizes.tolist()]
    maps, x, y = jaccard.Bitmaps([jaccard.bitmap(s) for s in sets]), *np.triu_indices(60, 1)
    got = maps.may_link(sizes, x, y, 80)
    linked = 100 * np.minimum(sizes[x], sizes[y]) >= 80 * np.maximum(sizes[x], sizes[y])
    one_by_one = [jaccard.least_difference(jaccard.bitmap(sets[i]), jaccard.bitmap(sets[j])) for i, j in zip(x, y)]
    assert got[linked].all() and not got.all()
    assert (got == (np.array(one_by_one) <= sizes[x] + sizes[y] - 2 * jaccard.required(sizes[x], sizes[y], 80))).all()


def test_no_common_subsequence_is_longer_than_the_words_an_item_has():
    rng = np.random.default_rng(7)
    passages = [rng.integers(0, 40, n).tolist() for n in (5, 20, 64)]
    member = np.unique([q * 40 + c for q, p in enumerate(passages) for c in p])
    code = rng.integers(0, 40, 300)
    first, item = rng.integers(0, 240, 500), rng.integers(0, 3, 500)
    end = first + rng.integers(0, 60, 500)
    for pairs in (decontaminate.PAIRS, 7):
        decontaminate.PAIRS, before = pairs, decontaminate.PAIRS
        got = decontaminate.words_in_items(code, first, end, item, member, 40)
        decontaminate.PAIRS = before
        assert got.tolist() == [sum(c in passages[q] for c in code[a:b].tolist()) for a, b, q in zip(first, end, item)]
    for a, b, q, most in zip(first, end, item, got):
        assert decontaminate.common_subsequence(decontaminate.place_bits(passages[q]), code[a:b].tolist(), len(passages[q])) <= most


def test_places_of_documents_are_found_at_once():
    docs = decontaminate.Coded(np.array([0, 0, 0, 2, 2]), np.array([1, 5, 9, 0, 7]), np.zeros(5, np.int64), np.array([10, 3, 8]))
    first, end = docs.between(np.array([0, 0, 1, 2]), np.array([2, 0, 0, 0]), np.array([9, 99, 75, 8]))
    assert [(a, b) for a, b in zip(first.tolist(), end.tolist())] == [(1, 2), (0, 3), (3, 3), (3, 5)]


def test_texts_are_encoded_a_few_at_a_time_and_first_words_in_one_call(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    code, sizes, calls = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")), [], []
    texts = [f"{prose(i, 3)}{i} {prose(i + 1, 20)}" for i in range(150)]
    encode, one = code.encode, code._ids
    monkeypatch.setattr(code, "encode", lambda some: sizes.append(len(some)) or encode(some))
    monkeypatch.setattr(code, "_ids", lambda text: calls.append(text) or one(text))
    got = code.encode_column(pa.array(texts))
    assert got == [np.array(code.tokenizer.encode(t, add_special_tokens=False).ids, code.dtype).tobytes() for t in texts]
    assert sizes == [64, 64, 22] and all(token_files.BETWEEN in t or len(t.split()) == 1 and t[0] == " " for t in calls)
