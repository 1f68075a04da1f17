"""The fixed schemas into which records of every shape are read."""

from __future__ import annotations

MEMORIES = """
ord bigint, memory_id string, category string, difficulty string, weight double,
time struct<absolute:string, relative:string, fuzzy:string, timestamp:bigint, era:string>,
location struct<city:string, place:string, landmark:string>,
person struct<name:string, identity:string, partner_name:string, partner_identity:string, relation:string>,
event struct<type:string, action:string, product:string, quantity:bigint, price:bigint>,
versions array<struct<version_id:string, style:string, content:string>>, content string, tags array<string>, cluster_id string,
reasoning_chain string, chain_id string, chain_position int, chain_hop int, chain_total int, chain_relation string, chain_prev string, chain_next string,
logic struct<type:string>, decay struct<level:string, access_count:int>, depth struct<layers:int, associations:int, semantic_distance:string>,
retrieval_keywords array<string>, attrs map<string, string>
"""

QUERIES = """
ord bigint, query_id string, query_text string, query_type string, test_dimension string, expected_memory_ids array<string>, expected_answer variant,
expected_answer_text string, acceptable_answers array<string>, expected_time string, difficulty string, search_depth string, is_negative boolean,
target_entity string, logic string, dimensions array<string>
"""

FACTS = "ord bigint, content string, person string, location string, time string, dynasty string, event_type string, chain_id string, chain_position int, chain_relation string, _source string"
