import random

from lodemill.llm.scans import Page, ScannedTexts, Trie, is_title, reflow

WORDS = "the lantern opens every harbour while another gardener repairs seven copper valves and our notebook describes quarterly tunnels within some narrow winter market before its drawing".split()


def clean_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def corpus(rng):
    return [(f"t{i}", "transcript_segment", clean_text(rng, 300), 1) for i in range(8)]


def defects(spark, rows):
    df = spark.createDataFrame(rows, "id string, kind string, text string, line_no int")
    return {tuple(r) for r in ScannedTexts(df).defects().collect()}


PAGE = "\n".join(
    [
        "Copper Harbour Of The Lantern",
        "the lantern opens every harbour while ano-",
        "ther gardener repairs seven copper va1ves",
        "",
        "12",
        "240",
        "7",
        "",
        "and our notebook describes the low-",
        "lying tunnels within some nar­",
        "row winter rnarket before its drawing.",
        "            31",
        "\x0cNarrow Valves Office   - 32 -",
        "every garclener opens the gar¬",
        "clener before the market.",
        "Copper Harb0ur Of The Lantern",
        "- 33 -",
    ]
)


def test_defects_by_line(spark):
    rng = random.Random(1)
    rows = corpus(rng) + [("c", "image_caption", "low-lying lantern " * 30, 1), ("p", "ocr_text", PAGE, 1), ("p", "ocr_text", PAGE, 1)]
    got = {x[1:] for x in defects(spark, rows) if x[0] == "p"}
    assert got == {
        (1, "header"), (2, "break"), (3, "misread"), (10, "break"), (11, "misread"), (12, "page_number"), (13, "header"),
        (14, "break"), (14, "misread"), (15, "misread"), (16, "header"), (17, "page_number"),
    }


def test_repaired_text(spark):
    rows = corpus(random.Random(1)) + [("c", "image_caption", "low-lying lantern " * 30, 1), ("p", "extracted_text", PAGE, 1)]
    df = spark.createDataFrame(rows, "id string, kind string, text string, fixes int")
    text = {r.id: r.text for r in ScannedTexts(df).repaired().collect()}["p"]
    assert "while another gardener repairs seven copper valves\n\n" in text
    assert "describes the low-lying tunnels within some narrow winter market before its drawing." in text
    assert text.endswith("every gardener opens the gardener before the market.")
    assert "Office" not in text and "31" not in text and "240" in text


def test_copies_of_a_text_keep_their_defects(spark):
    pages = [(f"p{i}", ("ocr_text", "extracted_text")[i % 2], "every garclener opens the harbour", 1) for i in range(80)]
    got = defects(spark, corpus(random.Random(1)) + pages + pages[:5])
    assert got == {(f"p{i}", 1, "misread") for i in range(80)}


def test_a_misread_word_is_repaired_in_the_language_of_its_text(spark):
    rows = [("en", "transcript_segment", "the lantern and the bend of our harbour " * 100, 1), ("de", "transcript_segment", "der garten und die hcnd ist nicht unser " * 300, 1)]
    rows += [("a", "ocr_text", "the lantern and the bcnd of our harbour", 1), ("b", "ocr_text", "der garten und die bcnd ist nicht unser", 1)]
    rows += [("two", "ocr_text", "the bcnd and the lantern", 1), ("two", "ocr_text", "die bcnd und der garten", 1)]
    df = spark.createDataFrame(rows, "id string, kind string, text string, line_no int")
    for part_words in (300_000, 5):
        got = sorted(tuple(r) for r in ScannedTexts(df, part_words=part_words).repaired().collect())
        assert got == [
            ("a", "the lantern and the bend of our harbour"), ("b", "der garten und die hcnd ist nicht unser"),
            ("two", "die hcnd und der garten"), ("two", "the bend and the lantern"),
        ]


def test_an_edit_is_repaired_where_the_neighbours_agree(spark):
    page = "the lantern opens every wjndow while another\ngovernent repairs seven vaIves in Winmow street"
    rows = [(f"t{i}", "transcript_segment", "the lantern opens every window while another government repairs seven valves; a window opens, the government repairs", 1) for i in range(8)]
    rows = [(i, k, t + " " + "and " * n, 1) for n, (i, k, t, _) in enumerate(rows)] + [("p", "ocr_text", page, 1)]
    df = spark.createDataFrame(rows, "id string, kind string, text string, line_no int")
    scans = ScannedTexts(df, ratio=4)
    assert {tuple(r)[1:] for r in scans.defects().collect()} == {(1, "misread"), (2, "misread")}
    assert [r.text for r in scans.repaired().collect()] == ["the lantern opens every window while another government repairs seven valves in Winmow street"]


def test_candidates_are_ranked_by_the_neighbours(spark):
    rows = [("a", "transcript_segment", "a red bend " * 40 + "on the road " + "the old hend is here " * 60, 1), ("b", "transcript_segment", "one bcat more", 1)]
    rows += [("p", "ocr_text", "see a red bcnd here", 1), ("c", "transcript_segment", "the cold bond sold " * 90, 1)]
    df = spark.createDataFrame(rows, "id string, kind string, text string, line_no int")
    assert [r.text for r in ScannedTexts(df).repaired().collect()] == ["see a red bend here"]


def test_nulls_empty_and_long(spark):
    assert defects(spark, []) == set()
    long = "\n".join(" ".join(random.Random(3).choices(WORDS, k=9)) for _ in range(4000))
    rows = corpus(random.Random(2)) + [(None, "ocr_text", PAGE, 1), ("a", None, PAGE, 1), ("b", "ocr_text", None, 1), ("e", "ocr_text", "", 1), ("l", "ocr_text", long, 1)]
    assert {x for x in defects(spark, rows) if x[0] in "abe"} == set()


def test_candidates_are_complete():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(300)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    trie = Trie(words)
    for word in ["abc", "bd", "eeee", "cabad", "xyz"]:
        found = trie.candidates(word)
        assert {k for k, w in enumerate(words) if edits(word, w) <= 1} <= set(found)
    assert words.index("ace") in trie.candidates("aec") if "ace" in words else True
    assert Trie(["modern", "under", "wheel"]).candidates("modem")[0][:2] == (0.5, 0)
    assert Trie(["modern", "under", "wheel"]).candidates("uriclcr")[1][:2] == (1.5, 0)


def test_page_furniture():
    page = Page("Intro text here.\n12\nmore text\n\n55\n66\n77\n13\n\nlast text\n14")
    assert page.number == {1, 7, 10}
    assert is_title("Dlm Thresh0ld Of The Harvest") and not is_title("Closed Early.") and not is_title("Tarova") and not is_title("The cat")
    assert reflow("", {}, set()) == ""
