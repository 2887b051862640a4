"""The log of changes and its replay, review pages and matches."""

import random

from letterworks.operators import entities, history, review

KIND = "resource_type string, resource_id string, at long, seq int, values map<string,string>"


def test_log_tells_what_changed_and_replays(spark):
    rows = [
        ("org", "1", 1, 0, {"name": "A", "status": "active"}),
        ("org", "1", 2, 1, {"name": "A", "status": "active"}),
        ("org", "1", 3, 2, {"name": "A", "status": "merged", "merged_into": "2"}),
        ("proposal", "7", 1, 0, {"status": "pending"}),
        ("proposal", "7", 2, 1, {"status": "rejected"}),
        ("proposal", "8", 1, 0, {"status": "pending"}),
        ("proposal", "8", 2, 1, {"status": "accepted", "linked_to": "1"}),
        ("deadline", "9", 1, 0, {"status": "open", "due": "x"}),
        ("deadline", "9", 2, 1, {"status": "snoozed", "snoozed_until": "2024-01-01", "due": "x"}),
        ("deadline", "9", 3, 2, {"status": "open", "due": "y"}),
        ("empty", "1", 1, 0, None),
    ]
    log = history.change_log(spark.createDataFrame(rows, KIND))
    got = {(r.resource_type, r.resource_id, r.at): (r.action, r.previous_json, r.new_json) for r in log.collect()}
    assert got == {
        ("org", "1", 1): ("created", None, '{"name":"A","status":"active"}'),
        ("org", "1", 3): ("merged", '{"status":"active"}', '{"merged_into":"2","status":"merged"}'),
        ("proposal", "7", 1): ("created", None, '{"status":"pending"}'),
        ("proposal", "7", 2): ("rejected", '{"status":"pending"}', '{"status":"rejected"}'),
        ("proposal", "8", 1): ("created", None, '{"status":"pending"}'),
        ("proposal", "8", 2): ("linked", '{"status":"pending"}', '{"linked_to":"1","status":"accepted"}'),
        ("deadline", "9", 1): ("created", None, '{"due":"x","status":"open"}'),
        ("deadline", "9", 2): ("status_changed", '{"status":"open"}', '{"snoozed_until":"2024-01-01","status":"snoozed"}'),
        ("deadline", "9", 3): ("changed", '{"due":"x","snoozed_until":"2024-01-01","status":"snoozed"}', '{"due":"y","snoozed_until":null,"status":"open"}'),
        ("empty", "1", 1): ("created", None, None),
    }
    last = {(r.resource_type, r.resource_id): r.values for r in history.replay(log).collect()}
    assert last[("deadline", "9")] == {"status": "open", "due": "y"} and last[("org", "1")]["merged_into"] == "2" and last[("empty", "1")] == {}


def test_any_log_replays_to_the_last_states(spark):
    draw = random.Random(2)
    rows, last = [], {}
    for at in range(300):
        k = str(draw.randrange(12))
        values = {x: draw.choice("uvw\"'") for x in draw.sample("abcde", draw.randrange(0, 5))}
        rows.append(("r", k, at, 0, values))
        last[k] = values
    log = history.change_log(spark.createDataFrame(rows, KIND))
    assert {r.resource_id: r.values for r in history.replay(log).collect()} == last
    again = history.change_log(spark.createDataFrame(rows + [("r", k, 999, 0, v) for k, v in last.items()], KIND))
    assert again.count() == log.count()


def test_review_page_counts_and_order(spark):
    docs = spark.createDataFrame([(1, 30, "needs_review", 5, ["w"]), (2, 10, "needs_review", 6, None), (3, 20, "ready", 7, None), (4, 10, "needs_review", 8, None)], "doc_id int, created_at int, status string, canonical_extraction_id int, warnings array<string>")
    p = spark.createDataFrame([(1, "pending"), (1, "pending"), (1, "accepted"), (2, "rejected")], "doc_id int, status string")
    k = spark.createDataFrame([(2, "pending")], "doc_id int, status string")
    c = spark.createDataFrame([(1, 5, None), (1, 5, None), (2, 99, None), (4, 8, "keep")], "doc_id int, baseline_id int, review_decision string")
    got = [tuple(r) for r in review.review_page(docs, p, k, c, 10).collect()]
    assert got == [(2, 10, [], 0, 1, False), (4, 10, [], 0, 0, False), (1, 30, ["w"], 2, 0, True)]
    assert [r.doc_id for r in review.review_page(docs, p, k, c, 1, 1).collect()] == [4]


def test_matches_are_attached_to_organizations_only(spark):
    page = spark.createDataFrame([(1, "organization", " haus  AG", []), (2, "organization", "Fremd", ["DE123456"]), (3, "deadline", "Haus AG", []), (4, "organization", "Neu", [])], "proposal_id long, proposal_type string, name string, strong array<string>")
    orgs = spark.createDataFrame([(7, "Haus AG", "active", 1), (8, "Werk KG", "active", 2)], "org_id long, canonical_name string, status string, created_at int")
    aliases = spark.createDataFrame([(8, "Werkstatt")], "org_id long, alias string")
    accepted = spark.createDataFrame([(70, 8, ["DE123456"], 3)], "proposal_id long, org_id long, strong array<string>, created_at int")
    got = {r.proposal_id: (r.possible_existing_organization_id, r.match_reason) for r in review.with_organization_match(page, orgs, aliases, accepted).collect()}
    assert got == {1: (7, "exact normalized canonical name"), 2: (8, "exact strong organization identifier"), 3: (None, None), 4: (None, None)}


def test_contract_page_lists_what_is_linked(spark):
    contracts = spark.createDataFrame([(1, 7), (2, None)], "contract_id int, organization_id long")
    orgs = spark.createDataFrame([(7, "Haus AG")], "org_id long, canonical_name string")
    events = spark.createDataFrame([(1, None, "later"), (1, "2024-02-01", "b"), (1, "2024-01-01", "a"), (9, None, "other")], "contract_id int, day string, value string")
    got = {r.contract_id: (r.canonical_name, [x.value for x in r.events], [x.value for x in r.actions]) for r in entities.contract_page(contracts, orgs, {"events": events, "actions": events.limit(0)}).collect()}
    assert got == {1: ("Haus AG", ["a", "b", "later"], []), 2: (None, [], [])}
