from collatrix.operators import review as R

TEXT = """# Review of an invented paper

### Readers:
- Somebody

## Round 1 comments

Dear authors,

### Section 2
L12: "teh" -> "the"
L8-9: say it otherwise
- L595-L597: explain the bound
- 760-761: put the inputs in a table
- L0 rate: no reference
- Figure 2: add a legend, as in Fig 24
- Figs39/40: odd
- Eq. 12: define f, Eqs. (13): brackets
- Sec 4.1 and Section 5.2.4 and App F
- Make this figure 2 columns wide?
- Figs 103-106: bigger
> Ans: done

### General
- A summary table is missing.

## Round 2 comments

> > L105: What is it for?
>
> It replaces the missing part.

Fine, can you say so? (now L132-135)

## Notes to self

- Check Figure 59 again
"""


def test_references():
    found = lambda t: [(r.kind, r.first, r.last, r.ids) for r in R.references(t)]
    assert found("L595-L597 and line 7") == [("line", 595, 597, []), ("line", 7, 7, [])]
    assert found("L0 trigger") == [] and found("see https://x.org/L12 and `L13`") == []
    assert found("Figs 103-106: big") == [("figure", 0, 0, ["103", "104", "105", "106"])]
    assert found("Figures 52 and 53") == [("figure", 0, 0, ["52", "53"])]
    assert found("- 760-761: list") == [("line", 760, 761, [])]
    assert found("this figure 2 columns wide") == []
    assert found("Sec 4.1 and App F") == [("section", 0, 0, ["4.1"]), ("section", 0, 0, ["F"])]
    assert [r.now for r in R.references("(now L132-135)")] == [True]


def test_snippets():
    assert R.snippets('"old" -> "new"') == ["old"]
    assert R.snippets("it's ‘a b’ and 'c d', don't") == ["a b", "c d"]


def test_remarks_of_a_review():
    review = R.Review(TEXT)
    assert review.rounds == ["Round 1 comments", "Round 2 comments"]
    texts = [r.text for r in review.remarks]
    assert texts[0].startswith('L12: "teh"') and "L0 rate: no reference" in texts and "A summary table is missing." in texts
    assert "Somebody" not in texts and not any(t.startswith("Dear") for t in texts)
    answered = next(r for r in review.remarks if r.text.startswith("Figs 103"))
    assert answered.reply == "done"
    follow = next(r for r in review.remarks if r.round == 1)
    assert [(r.first, r.round, r.now) for r in follow.references] == [(105, 0, False), (132, 1, True)]
    assert follow.quoted == "L105: What is it for?" and follow.reply == "It replaces the missing part."
    assert review.remarks[-1].notes and TEXT[follow.span[0] :].startswith("> > L105")
    for r in review.remarks:
        assert all(TEXT[x.start : x.end] == x.text for x in r.references)


def test_removal_and_annotation():
    review = R.Review(TEXT)
    follow = next(r for r in review.remarks if r.round == 1)
    left = R.without_remark(TEXT, follow)
    assert "L105" not in left and "\n\n\n" not in left and len(R.Review(left).remarks) == len(review.remarks) - 1
    assert R.annotated("- L19: x", [(5, "v1.1: L26, changed")]) == "- L19 [v1.1: L26, changed]: x"
    assert R.stable_key("a") == "e40c292c"


def test_tables(spark):
    frame = spark.createDataFrame([("r", TEXT), ("empty", None)], "review_id string, text string")
    assert R.remarks(frame).where("review_id = 'empty'").count() == 0
    assert R.remark_references(frame).where("kind = 'line'").count() == 6
