"""Candidates of fuzzy matching where one text has more copies than the prefilter keeps."""

from tidemark.operators.matching import similar_marks


def test_own_id_takes_no_place_among_the_copies(spark):
    """Of 20 copies the item is the first; the 16th id, its only copy of equal classes, ranks first."""
    rows = [(k, "golden harbour", [1, 2] if k in (1, 16) else [30 + k]) for k in range(1, 21)]
    marks = spark.createDataFrame(rows, "id long, text string, classes array<int>")
    for item, best in ((1, 16), (20, 1)):
        asked = marks.where(f"id = {item}")
        found = {r["rank"]: r.mark_id for r in similar_marks(asked, marks).collect()}
        assert len(found) == 5 and found[1] == best
