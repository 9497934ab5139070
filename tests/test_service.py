from lineseek.operators import service
from lineseek.sources import index

LINES = ["test line 1", "test line 2", "another test line", "final test line", "Final TEST line"]


def test_requests_are_answered_end_to_end(spark, corpus_of):
    raws = [
        "test", "test", "TEST", '{"query":"test"}', '{"query":"TEST","options":{"case_sensitive":true}}',
        '{"pattern":"test line 1","options":{"whole_line":true}}', '{"query":"[0-9]$","options":{"regex":true}}',
        '{"query":"test","options":{"max_count":2}}', '{"query":"zzz"}', '{"command":"health"}', '{"command":"zap"}', " ",
        '{"query":"te[","options":{"regex":true}}', '{"query":"final","options":{"invert":true}}',
    ]
    log = spark.createDataFrame(list(enumerate(raws)), "id bigint, raw string")
    responses, matches = service.answer(log, index.build(corpus_of(LINES)))
    got = {r.id: (r.error_code, r["count"]) for r in responses.collect()}
    assert len(got) == responses.count() == len(raws)
    assert [got[i] for i in range(len(raws))] == [
        (None, 4), (None, 4), (None, 4), (None, 4), (None, 1), (None, 1), (None, 2), (None, 2), (None, 0), (None, None),
        ("INVALID_REQUEST", None), ("INVALID_REQUEST", None), ("INVALID_PATTERN", None), (None, 3),
    ]
    by_query = {r.id: r.query_id for r in responses.collect()}
    assert by_query[0] == by_query[1] == by_query[3] and by_query[0] != by_query[2]
    two = matches.where(matches.query_id == by_query[7]).orderBy("first_pos").collect()
    assert [r.line for r in two] == LINES[:2]
