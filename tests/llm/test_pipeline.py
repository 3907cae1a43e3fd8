"""The pipeline on a small table: every stage's decisions take effect, columns pass, clean documents stay."""

import random

import corpus_pipeline
from tests.llm.test_operators import prose, within_one


def test_stages(spark, tmp_path):
    clean = [(i, prose(i, 80)) for i in range(160)]
    bad = [(1000 + i, " ".join(w + "&&&" for w in prose(2000 + i, 80).split())) for i in range(60)]
    item = prose(5000, 30)
    copy = (3000, clean[3][1])  # every line repeats
    near = (3001, clean[4][1] + " new end")  # one line, too far for one edit, near enough for a link
    leak = (3002, prose(6000, 40) + " " + item + " " + prose(6001, 40))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*clean, *bad, copy, near, leak, (3003, None), (3004, "")]]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        left.append({r[0] for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {i for i, _ in clean}
    assert left[0] == ids | {3000, 3001, 3002}
    assert left[1] == ids | {3001, 3002} and left[2] == ids | {3002}
    assert left[3] == left[4] == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "jaccard", "decontaminate", "pieces"]


def shingle_similarity(a, b, width):
    x, y = ({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_jaccard_stage_links_at_four_fifths_of_five_word_shingles(spark):
    rng, rows = random.Random(21), []
    for base in range(8):
        words = prose(7000 + base, 150).split()
        for copy in range(8):  # changes at one end leave more of the five-word shingles than changes all over
            changed = list(words)
            for at in rng.sample(range(150), rng.randint(0, 4)):
                changed[at] = f"new{base}x{copy}x{at}"
            rows.append((100 * base + copy, " ".join(changed[: 150 - rng.randint(0, 14)])))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    between = 0
    for i, a in rows:
        for j, b in rows:
            if i < j and shingle_similarity(a, b, 5) >= 0.8:
                between += shingle_similarity(a, b, 3) < 0.9
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert between >= 20
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.jaccard_stage(spark, table, "").select("doc_id").collect()}
    assert left == {i for i, _ in rows if root(i) == i}


def within_one_word(a, b):
    a, b = a.split(" "), b.split(" ")
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def test_line_stage_drops_lines_with_one_word_edited(spark):
    rng, texts = random.Random(22), []
    base = [prose(8000 + s, n) for s, n in enumerate([7, 8, 9, 12, 20, 60])]
    for _ in range(50):
        lines = []
        for line in rng.choices(base, k=3):
            words = line.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(len(words))
                words[p : p + rng.randint(0, 1)] = rng.choice([[], [f"unlike{rng.randint(0, 30)}"]])
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    seen, want, by_word = [], {}, 0
    for i, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            by_char = any(line == s or within_one(line, s) for s in seen)
            near = by_char or any(min(line.count(" "), s.count(" ")) >= 7 and within_one_word(line, s) for s in seen)
            by_word += near and not by_char
            kept += [] if near else [line]
            seen.append(line)
        if kept:
            want[i] = "\n".join(kept)
    assert by_word >= 30 and sum(t.count("\n") + 1 for t in want.values()) >= 30
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, table, "").collect()} == want
