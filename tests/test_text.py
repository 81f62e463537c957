from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import checks, dedup


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_tokens_ignore_outer_space_and_keep_other_alphabets(spark):
    assert one(spark, "  Äpfel\tund\nBirnen ", T.tokens) == ["äpfel", "und", "birnen"]
    assert one(spark, " \n ", T.tokens) == []


def test_counted_counts_every_word(spark):
    got = one(spark, "b a b c b a", lambda c: T.counted(T.tokens(c)))
    assert [(r["term"], r["tf"]) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, "", lambda c: T.counted(T.tokens(c))) == []


def test_noise_lines_keep_blank_lines_and_real_contents(spark):
    text = "Contents\nChapter 1\n....5\n\nPage 3\n---\n 12 \nTable of Contents\nBody"
    assert one(spark, text, T.filter_noise_lines) == "Contents\nChapter 1\n....5\n\nBody"


def test_repair_line_breaks(spark):
    assert one(spark, "A\n\n\n\nB\n -  Cat\n•Dog\nand more\n 1. First\n;\nend", T.repair_line_breaks) == (
        "A\n\nB\n- Cat\n• Dog and more\n1. First\n; end")
    assert one(spark, "One\n ; \nTwo", T.repair_line_breaks) == "One\nTwo"


def test_thin_lines(spark):
    assert one(spark, "ab\n--\n\n----------\nlong enough line", T.drop_thin_lines) == "ab\n----------\nlong enough line"


def test_valid_chunk_borders(spark):
    for n, ok in [(49, False), (50, True), (51, True)]:
        assert one(spark, "a" * n, T.chunk_is_valid) is ok
    assert one(spark, "1" * 60, T.chunk_is_valid) is False


def test_trim_to_sentence_looks_at_the_last_99_characters(spark):
    assert one(spark, "One. Two", T.trim_to_sentence) == "One."
    assert one(spark, "Done. ", T.trim_to_sentence) == "Done. "
    assert one(spark, "A." + "x" * 99, T.trim_to_sentence) == "A." + "x" * 99
    assert one(spark, "A." + "x" * 98, T.trim_to_sentence) == "A."
    assert one(spark, ".x", T.trim_to_sentence) == ".x"


def test_key_terms_are_whole_words(spark):
    text = "The New York Café and Big Apple. A B C D E F G H"
    assert one(spark, text, T.extract_key_terms) == ["The New York", "Big Apple", "A B C D E F", "G H"]


def test_links_in_order_without_repeats(spark):
    text = '[a](http://x.org/1) http://y.org/2 <a href="http://z.org">z</a> http://z.org http://y.org/2'
    got = [(r["text"], r["url"]) for r in one(spark, text, T.extract_links)]
    assert got == [("a", "http://x.org/1"), ("z", "http://z.org"), ("http://y.org/2", "http://y.org/2")]


def test_jaccard_and_overlap_of_empty_texts(spark):
    df = spark.createDataFrame([("", "a"), ("a b", "b c"), ("a", "")], "x string, y string")
    rows = df.select(T.jaccard_words(F.col("x"), F.col("y")).alias("j"), T.word_overlap(F.col("x"), F.col("y")).alias("o")).collect()
    assert [(round(r["j"], 6), round(r["o"], 6)) for r in rows] == [(0, 0), (0.333333, 0.5), (0, 0)]


def test_answer_json_falls_back_to_the_text(spark):
    df = spark.createDataFrame([('{"answer":"x","sources":["s"],"confidence":0.9}',), (" no json ",), ("[1",)], "r string")
    rows = df.select(*checks.parse_answer_json(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("x", ["s"], 0.9), ("no json", [], 0.5), ("[1", [], 0.5)]


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(dedup.sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0]


def test_file_names(spark):
    assert one(spark, ' a<b>:"c?.txt. ', T.clean_filename) == "a_b___c_.txt"
    assert one(spark, " .. ", T.clean_filename) == "unnamed_file"
    assert one(spark, "x" * 300 + ".txt", T.clean_filename) == "x" * 251 + ".txt"


def test_structure_flags_find_a_bullet_inside_the_text(spark):
    assert one(spark, "Intro\n - item", T.has_bullets) is True
    assert one(spark, "a-b", T.has_bullets) is False
