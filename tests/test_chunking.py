import random

from pyspark.sql import functions as F

from reedmill.operators import chunking as C
from reedmill.operators import flat_chunks as S


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def ranges(n, size, overlap):
    return [(t.split()[0], len(t.split())) for t, *_ in C.token_windows(words(n), size, overlap)]


def test_token_windows():
    assert [ranges(*c) for c in ((0, 5, 2), (5, 5, 2), (6, 5, 2), (8, 5, 2), (9, 5, 2), (3, 2, 2), (4, 2, 5))] == [
        [], [("w0", 5)], [("w0", 5), ("w3", 3)], [("w0", 5), ("w3", 5)], [("w0", 5), ("w3", 5), ("w6", 3)], [("w0", 2), ("w1", 2)], [("w0", 2), ("w1", 2), ("w2", 2)],
    ]


def packed(lengths, overlap=3):
    sentences = [words(n, chr(97 + i)) + "." for i, n in enumerate(lengths)]
    return ["".join(sorted({w[0] for w in p.split()})) for p in C.sentence_windows(" ".join(sentences), 10, overlap)]


def test_sentence_windows():
    for overlap in (3, 0):
        assert packed([4, 4, 4], overlap) == ["ab", "bc"]
        assert packed([9, 3, 3], overlap) == ["a", "ab", "bc"]
        assert packed([3, 3, 3, 3], overlap) == ["abc", "cd"]
    assert packed([3, 12, 3]) == ["a", "b", "b", "c"]
    assert list(C.sentence_windows("...", 10, 3)) == ["..."] and list(C.sentence_windows("  ", 10, 3)) == []


def test_flat_passages():
    def run(lengths, least=0):
        got = S.passages([words(n, chr(97 + i)) for i, n in enumerate(lengths)], S.blank_tokens(), 10, 3, least)
        return ["".join(sorted({w[0] for w in p.split()})) for p in got]

    assert run([4, 4, 4]) == ["ab", "c"] and run([9, 3, 3]) == ["a", "bc"] and run([3, 3, 3, 3]) == ["abc", "cd"] and run([3, 12, 3]) == ["a", "b", "b", "c"]
    assert run([4, 4, 4], 5) == ["ab"] and run([2, 9, 3], 50) == ["ab"] and run([]) == []


def reference_recursive(text, size, overlap, seps=C.SEPARATORS):
    def refine(t, rest):
        if len(t) <= size or not rest:
            return [t]
        if rest[0] not in t:
            return refine(t, rest[1:])
        pieces = t.split(rest[0])
        pieces = [p + rest[0] for p in pieces[:-1]] + [pieces[-1]]
        return [x for p in pieces if p for x in refine(p, rest[1:])]

    out, cur = [], ""
    for p in refine(text, seps):
        if cur and len(cur + p) > size:
            out.append(cur)
            cur = (cur[-overlap:] if overlap else "") + p
        else:
            cur += p
    return [x.strip() for x in [*out, cur] if x.strip()]


def test_recursive_parts():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", "bb", " ", ". ", "\n", "\n\n", "? ", "cccc"]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(3, 25), rng.randint(0, 6)
        assert [p.strip() for p in C.recursive_parts(text, size, overlap) if p.strip()] == reference_recursive(text, size, overlap)


def test_located_follows_the_cursor():
    assert [u[1:3] for u in C.located("a b a b a", iter(["a b", "b a", "zz"]))] == [(0, 3), (6, 9), (9, 11)]


def test_paragraphs():
    assert C.paragraphs("\n\n a \nb\n") == [("paragraph_000", "a", 2), ("paragraph_001", "b", 6)] and C.paragraphs("x") == [("content", "x", 0)] and C.paragraphs(" \n ") == []


def frame(spark, contents):
    return spark.createDataFrame([(str(i), "t", None, "c", x) for i, x in enumerate(contents)], "article_id string, title string, description string, category string, content string").selectExpr("*", "1 as units", "2 as unit", "3 as small")


def test_native_equals_python(spark):
    rng = random.Random(5)
    contents = ["".join(rng.choice(["a", "é", "😀", " ", "  ", "\n", " ", "　"]) for _ in range(rng.randint(0, 120))) for _ in range(80)] + [None, "", " \n", words(300)]
    df = frame(spark, contents)
    for size, overlap in ((5, 2), (7, 0), (2, 5)):
        c = C.ChunkingConfig(chunk_size=size, overlap=overlap, min_chunk_tokens=0, small_article_chars=0)
        a, b = (sorted(map(str, C.chunks(df, c, native).collect())) for native in (True, False))
        assert a == b and a


def merged(left, right):
    a, b = left.split(), right.split()
    k = next((k for k in range(min(len(a), len(b)), 0, -1) if a[-k:] == b[:k]), 0)
    return " ".join(a + b[k:])


def test_tail_merge(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
    rows = [(text(), text()) for _ in range(600)] + [("", ""), ("a", ""), ("", "a")]
    df = spark.createDataFrame(rows, "l string, r string")
    assert [r.m for r in df.select(C.merged_words(F.col("l"), F.col("r")).alias("m")).collect()] == [merged(a, b) for a, b in rows]


def test_assembly(spark):
    content = words(20) + ".\n" + words(6, "z") + "."
    df = frame(spark, [content, "short", "", None, " "])
    got = C.chunks(df, C.ChunkingConfig("structured", 8, 2, 5, 10, None)).orderBy("chunk_id").collect()
    mine = [r for r in got if r.article_id == "0"]
    assert [r.metadata.chunk_index for r in mine] == list(range(len(mine))) and {r.metadata.num_chunks for r in mine} == {len(mine)}
    assert [r.chunk_text for r in got if r.article_id == "1"] == ["short"] and {r.article_id for r in got} == {"0", "1"}
    assert got[-1].metadata.implementation == "single_small_article" and got[-1].text == "Tiêu đề: t\nChuyên mục: c\nĐoạn nội dung:\nshort"
    capped = C.chunks(df, C.ChunkingConfig(chunk_size=4, overlap=1, min_chunk_tokens=0, small_article_chars=10, max_chunks_per_article=2))
    stats = C.chunk_stats(df, capped).first()
    assert (stats.articles_read, stats.empty_articles, stats.truncated_articles, stats.chunks_written) == (5, 3, 1, 3)
    assert C.chunks(df.limit(0)).count() == 0
    assert S.flat_chunks(df, 10, 3, 1).where("article_id = 0").count() > 1
    assert S.flat_stats(df, S.flat_chunks(df)).first().skipped_empty == 3
