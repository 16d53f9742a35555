"""Common blocks go whatever else the documents share."""

import brute

from peakweave.llm.line_dedup import dedup_lines, filter_lines


def _left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.text for r in filter_lines(df).collect()}


def test_frequent_line_goes_without_a_rare_one(spark):
    """Every document has the line, and nothing else is shared; the first keeps it."""
    line = "All readers are asked to return this page today."
    own = [f"Document {i} has a line of its own number {i}." for i in range(60)]
    left = _left(spark, [f"{line}\n{x}" for x in own])
    assert left[0] == f"{line}\n{own[0]}"
    assert all(left[i] == own[i] for i in range(1, 60))


def test_like_brute_force_at_every_frequency(spark, docs, rows):
    found, name = dedup_lines(docs)
    got = {r.doc_id: (r[name].n_lines, r[name].n_removed) for r in found.collect()}
    assert got == brute.op3(rows)


P, Q, R = ("A passage that is held by many documents, part %s." % x for x in "pqr")


def test_line_repeated_in_its_first_document(spark):
    """The first document has the line twice; the later ones that have it once lose it, and a second one where no second was before stays."""
    own = [f"Document {i} has a line of its own number {i}." for i in range(4)]
    left = _left(spark, ["\n".join([P, own[0], P]), f"{own[1]}\n{P}", f"{P}\n{own[2]}", "\n".join([P, P, own[3], P])])
    assert left == {0: f"{P}\n{own[0]}\n{P}", 1: own[1], 2: own[2], 3: f"{own[3]}\n{P}"}


def test_lines_in_another_order(spark):
    """Lines cross those of their owner, with a short line between them; two later documents have them alike."""
    own = [f"Document {i} has a line of its own number {i}." for i in range(3)]
    left = _left(spark, ["\n".join([R, own[0], P, "short", Q]), *("\n".join([P, "short", Q, x, R]) for x in own[1:])])
    assert left == {0: "\n".join([R, own[0], P, "short", Q]), 1: own[1], 2: own[2]}
    left = _left(spark, ["\n".join([P, "short", Q, own[0], R]), *("\n".join([R, x, P, "short", Q]) for x in own[1:])])
    assert left[1] == own[1] and left[2] == own[2]


def test_a_document_more_hides_no_copy(spark):
    """Whether the first document has the block twice or not, later documents lose theirs."""
    block = [f"Line {k} of a block that is held by three documents." for k in range(4)]
    assert _left(spark, ["\n".join(block + ["Between the two blocks stands this line."] + block), "\n".join(block), "\n".join(block)]).keys() == {0}
    assert _left(spark, ["\n".join(block), "\n".join(block)]).keys() == {0}


def test_short_lines_with_a_partner_that_is_not_the_first(spark):
    """The first document shares one line, the second the short lines beside it too."""
    left = _left(spark, [P, "\n".join([P, "short", "verse"]), "\n".join(["Own words of the third document.", P, "short", "verse"])])
    assert left[1] == "short\nverse" and left[2] == "Own words of the third document."


def test_lists_of_short_lines(spark):
    left = _left(spark, ["\n".join("abcdefgh"), "Own words of the second document.\n" + "\n".join("bcdefg"), "a b", "a b"])
    assert left == {0: "\n".join("abcdefgh"), 1: "Own words of the second document.", 2: "a b"}


def test_random_documents_of_repeated_blocks(spark):
    import random

    rng = random.Random(11)
    lines = ["x", "y", "z z", *(f"a longer line of words {k}" for k in "uvw")]
    for _ in range(4):
        texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(40)]
        found, name = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
        assert {r.doc_id: (r[name].n_lines, r[name].n_removed) for r in found.collect()} == brute.op3(list(enumerate(texts)))


def test_moved_lines_are_told_apart(spark):
    a, b = ([f"A line of part {k} number {i} in its own order." for i in range(3)] for k in "ab")
    found, name = dedup_lines(spark.createDataFrame([(0, "\n".join(a + b[:1])), (1, "\n".join(b[:1] + a))], "doc_id bigint, text string"))
    assert {r.doc_id: tuple(r[name])[1:] for r in found.collect()} == {0: (4, 0, 0), 1: (4, 4, 1)}
