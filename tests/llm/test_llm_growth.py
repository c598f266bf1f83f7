"""What an operation does as its tables grow."""

from millrace.llm.spelling import one_edit_pairs
from millrace.plans.scratch import Scratch


def test_words_are_not_broadcast(spark, capsys):
    """Small files of words hold more rows than a driver can: their joins are not decided by file size."""
    words = Scratch(spark, "words").save(spark.range(2000).selectExpr("concat('word', id) as word", "id + 3 as n"), "words")
    one_edit_pairs(words).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_floors_are_of_all_rows(spark):
    """More rows of a language than a sample would hold; the floor is the exact quantile of all their scores."""
    import zlib

    import numpy as np

    from millrace.llm.language_id import FLOOR_QUANTILE, NOISE_FLOOR, fit_floors, fit_profiles, predict_languages

    syllables = ["ba", "de", "ki", "lo", "mu", "na", "po", "re", "si", "tu", "va", "zo"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(rng.choice(syllables, 3)) for _ in range(8)), "aa") for i in range(7000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    profiles = fit_profiles(d, rows_per_language=None)
    scored = predict_languages(d, profiles).collect()
    own = [r.score for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and 32 <= len(r.text) < 64]
    assert len(own) > 4500 and abs(fit_floors(d, profiles)["aa"][5] - np.quantile(own, FLOOR_QUANTILE)) < 1e-9
    assert fit_floors(d, profiles)["aa"][15] >= NOISE_FLOOR
