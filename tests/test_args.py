import pytest
from pyspark.sql import functions as F

from corvina.plans.args import Operator, QueryArgs, parse_args, parse_lines

PANGRAM = "Nezvyčajné kŕdle šťastných figliarskych vtákov učia pri kótovanom Váhu"


@pytest.mark.parametrize(
    "argv, expected",
    [
        (["Kto je prezident USA?", "-o", "-n", "5", "-x", "250"], ("Kto je prezident USA?", Operator.OR, 5, 250)),
        (["kolko je 5+5?"], ("kolko je 5+5?", Operator.AND, 10, 1000)),
        (["Som clovek?", "-o"], ("Som clovek?", Operator.OR, 10, 1000)),
        (["Kto je najlepsi?", "-n", "15"], ("Kto je najlepsi?", Operator.AND, 15, 1000)),
        (["test", "-x", "250"], ("test", Operator.AND, 10, 250)),
        ([""], ("", Operator.AND, 10, 1000)),
        (["", "-o"], ("", Operator.OR, 10, 1000)),
        (["test", "-m"], ("test", Operator.AND, 10, 1000)),
        (["test", "-m", "5"], ("test", Operator.AND, 10, 1000)),
        ([PANGRAM, "-m", "5", "-n", "15", "-o"], (PANGRAM, Operator.OR, 15, 1000)),
        (["Kde byva elizabeth the second", "-n", "-x"], ("Kde byva elizabeth the second", Operator.AND, 10, 1000)),
    ],
)
def test_grammar(argv, expected):
    assert parse_args([None, *argv], validate=False) == QueryArgs(*expected)


def test_hyphen_ends_the_question_and_empty_is_refused():
    assert parse_args("česko-slovensko").query == "česko"
    with pytest.raises(ValueError):
        parse_args("-n 5")


def test_lines_of_a_table(spark):
    lines = ["Kto je prezident USA? -o -n 5 -x 250", "  test  ", "a-b -n 3", "-o", "", None, "test -n 99999999999999", "x -x 7 -x 8 -nn 4"]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", parse_lines(F.col("line")).alias("a")).orderBy("i").collect()
    for line, r in zip(lines, got):
        a = parse_args(line or "", validate=False)
        n = 10 if "9999" in (line or "") else a.results_count  # too large for an int: the default
        assert (r.a.query, r.a.operator, r.a.n, r.a.x) == (a.query, a.boolean_operator.name, n, a.relevant_documents_count)
