import hashlib

from pyspark.sql import functions as F

from tallyline.llm import fingerprints as fp


def test_chunks_cover_a_text_and_move_with_it():
    data = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(200))
    ends = fp.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= fp.MOST and min(sizes[:-1]) >= fp.LEAST
    whole, moved = (fp.as_set(fp.digests(d, fp.cuts(d))) for d in (data, b"inserted" + data))
    assert fp.likeness(whole, moved) > 0.95 and fp.likeness(whole, whole) == 1.0
    assert fp.likeness(fp.as_set([]), fp.as_set([])) == 1.0 and fp.likeness(fp.as_set([]), whole) == 0.0 == fp.likeness(whole, fp.as_set([]))


def test_edited_chunks_equal_chunks_made_anew(rows):
    texts = [r[1] for r in rows if r[1]]
    for a, b in zip(texts, texts[1:]):
        data, chunks = fp.Chunked(a).edited(b)
        assert (chunks == fp.as_set(fp.digests(data, fp.cuts(data)))).all()


def brute(rows):
    out = []
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    pairs = list(zip(named, [*named[1:], *named[:1]])) + [(r, r) for r in rows if r[0] is None]
    for (i, a, *_), (_, b, *_) in pairs:
        a, b = a or "", b or ""
        q = len(a) // 4
        edited = a[: len(a) - q] + b[:q]
        x, e, y = fp.Chunked(a), fp.Chunked(edited), fp.Chunked(b)
        out.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), fp.written(x.chunks), fp.written(e.chunks), fp.likeness(x.chunks, e.chunks), fp.likeness(x.chunks, y.chunks)))
    return sorted(out, key=repr)


def test_neighbours_meet_whatever_the_ranges(docs, no_docs, rows):
    want = brute(rows)
    for parts in (1, 3, 40):
        got = fp.document_fingerprints(docs.withColumn("part", F.lit(9)), parts=parts).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert fp.document_fingerprints(no_docs).count() == 0
    one = fp.document_fingerprints(docs.where("doc_id = 16"), parts=4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
