from pyspark.sql import functions as F

from lexiqua.functions import prompts, slots


def read(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_the_first_phrase_counts_and_of_those_that_begin_together_the_longest(spark):
    place = lambda c: slots.place(slots.spaced(c), {"to", "up", "up to"})
    assert [v and (v.at, -v.less) for v in read(spark, place, ["go Up  to it", "to up", "upto", None, ""])] == [(4, 5), (1, 2), None, None, None]


def test_halves_and_closers(spark):
    pair = lambda c: slots.pair(slots.asked(c), {"are"}, {"and"}, {"the same", "same"}, first=True)
    got = [v and (v.a, v.b) for v in read(spark, pair, ["Are cats and dogs the same?", "are and dogs same", "they are a and b same", "are a and b", "ARE  a  and  b  SAME ..."])]
    assert got == [("cats", "dogs"), None, None, None, ("a", "b")]


def test_requests_of_any_order(spark):
    assert read(spark, prompts.asked_terms, ["Compare cats with dogs!", "what's the difference between a wolf and the dogs?", "Describe  the stars briefly.", "stars", None, "define"]) == [["cat", "dog"], ["wolf", "dog"], ["star"], None, None, None]
    assert read(spark, prompts.definition_terms, ["define cats, dogs and birds", "Give me a short definition of rain", "What is the definition of x or y?", "definitions of a, b", "rain", None]) == [["cat", "dog", "bird"], ["rain"], ["x", "y"], ["a", "b"], [], []]
    changes = read(spark, prompts.patch_intent, ["replace 'a b' with \"c d\" now", "change x y into z", "patch foo -> bar baz", "patch: rename 'to' to 'from'", "patch: p to q", "replace this", "hello to you", None])
    assert [v and (v.old, v.new) for v in changes] == [("a b", "c d"), ("x y", "z"), ("foo", "bar baz"), ("to", "from"), ("patch: p", "q"), None, None, None]
    compared = read(spark, prompts.compared_terms, ["Is a cat a kind of animal?", "does rain mean water", "which is larger: mars or venus?", "are a and b equivalent?", "are cats related to dogs", "is it raining", None])
    assert [v and (v.a, v.b) for v in compared] == [("a cat", "animal"), ("rain", "water"), ("mars", "venus"), ("a", "b"), ("cats", "dogs"), None, None]
