"""Keys that stand in one run with a name or a path."""

import random

from crawlens.llm import secrets

AWS = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def test_keys_in_runs_are_found(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, more="": "".join(rng.choice(letters + more) for _ in range(n))
    hook, padded, mixed = key(32), key(42, "+/") + "==", "q7Rk2ZbX9/vT4mL1+wPc8Y/nD5sJ3f/Gh6Ka0"
    texts = [f"AWS_SECRET_ACCESS_KEY={AWS}", f"post to https://x.example.com/services/T00_a/B00/{hook} now", f"export SOME_NAME={padded}", f"NAME_OF_IT-{mixed}_END", "A_PLAIN_NAME=some-long-page-slug-name2/with_words-and/more_words", None, "===================="]
    rows = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).cache()
    tested = {r["doc_id"]: {texts[r["doc_id"]][x["start"] : x["end"]] for x in r[secrets.TESTED]} for r in rows.collect()}
    assert AWS in tested[0] and hook in tested[1] and padded in tested[2] and mixed in tested[3]
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert clean[0] == "AWS_SECRET_ACCESS_KEY=[secret]" and hook not in clean[1] and clean[2] == "export SOME_NAME=[secret]" and mixed not in clean[3]
    assert [clean[i] for i in (4, 5, 6)] == texts[4:]
