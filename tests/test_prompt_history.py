"""Prompts read the turns of their questions, not all conversations."""

from corpuspark.operators.retrieval import build_prompt


def test_history_of_the_questions_only(spark):
    history = spark.createDataFrame([(q, i, "user", f"t{i}") for q in range(4) for i in range(10)], "query_id long, id long, role string, content string")
    questions = spark.createDataFrame([(1, "what"), (9, "why")], "query_id long, query_text string")
    contexts = spark.createDataFrame([(1, "c")], "query_id long, context string")
    found = build_prompt(questions, contexts, history)
    told = "".join(f"user: t{i}\n" for i in range(2, 10))
    assert {tuple(r) for r in found.collect()} == {(1, f"{told}\nc\n\nwhat"), (9, "\n\n\nwhy")}
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()  # before turns are dealt out
