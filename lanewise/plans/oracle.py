"""The queries' SQL for DuckDB, on the same projection of the events table."""

from __future__ import annotations

from lanewise.sources.board_log import EVENTS_SQL

COMB = "{0}_name || '[' || substr({0}_id, 19, 6) || ']'"
ACTIONS = "('updateCard', 'addMemberToCard', 'commentCard', 'addChecklistToCard', 'updateCheckItemStateOnCard', 'removeMemberFromCard', 'updateChecklist', 'removeChecklistFromCard', 'addAttachmentToCard', 'deleteAttachmentFromCard')"
LISTS = "('createList', 'updateList', 'moveListFromBoard', 'moveListToBoard')"
BASE = f"""
WITH RECURSIVE log AS MATERIALIZED ({EVENTS_SQL.format(events="events")}),
e AS MATERIALIZED (SELECT *,
  CASE WHEN list_closed THEN 'list_ends' WHEN type = 'moveListFromBoard' THEN 'list_move' WHEN type = 'updateList' AND old_name IS NOT NULL THEN 'list_rename'
       WHEN type = 'updateList' THEN 'list_change' WHEN type = 'moveListToBoard' THEN 'list_import' WHEN type = 'createList' THEN 'list_create' END AS l,
  CASE WHEN card_closed THEN 'card_close' WHEN type = 'deleteCard' THEN 'card_delete' WHEN list_before_id IS NOT NULL THEN 'card_move'
       WHEN type IN ('createCard', 'copyCard') THEN 'card_create' WHEN type IN {ACTIONS} THEN 'card_act' END AS c,
  CASE WHEN list_before_id IS NOT NULL THEN {COMB.format("list_before")} ELSE {COMB.format("list")} END AS list_comb,
  {COMB.format("list_before")} AS list_before_comb, {COMB.format("list_after")} AS list_after_comb FROM log),
board AS (SELECT board_id, min(date) AS t0, max(date) AS t1, date_diff('microsecond', min(date), max(date)) AS life FROM log GROUP BY board_id),
names AS (SELECT board_id, list_id, first(name ORDER BY rank DESC) AS name FROM (
  SELECT board_id, list_id, rank, first(name ORDER BY date DESC, id DESC) FILTER (WHERE name IS NOT NULL) AS name FROM (
    SELECT board_id, date, id, list_id, list_name AS name, 0 AS rank FROM log UNION ALL
    SELECT board_id, date, id, list_after_id, list_after_name, 1 FROM log UNION ALL
    SELECT board_id, date, id, list_before_id, list_before_name, 2 FROM log) WHERE list_id IS NOT NULL GROUP BY ALL) GROUP BY board_id, list_id)
"""


def _redesigns(le: str = "l IS NOT NULL", flag: str = "le OR date < min(date) OVER (PARTITION BY board_id, seg) + INTERVAL 3 HOUR") -> str:
    return f""", r1 AS (SELECT *, coalesce({le}, false) AS le FROM e),
r2 AS (SELECT *, sum(le::INT) OVER (PARTITION BY board_id ORDER BY date, id) AS seg FROM r1),
r3 AS (SELECT *, {flag} AS r FROM r2),
r4 AS (SELECT *, r AND NOT lead(r, 1, false) OVER (PARTITION BY board_id ORDER BY date, id) AS s FROM r3),
r5 AS (SELECT *, sum(s::INT) OVER (PARTITION BY board_id ORDER BY date DESC, id DESC) AS run FROM r4),
ev_r AS (SELECT board_id, run, min(date) AS min_ts, max(date) AS max_ts, count(*) AS n_events FROM r5 WHERE r GROUP BY board_id, run),
ev_l AS (SELECT board_id, run, count(id) AS n_list_events FROM r5 WHERE l IS NOT NULL GROUP BY board_id, run),
red AS (SELECT board_id, run::BIGINT AS run, min_ts, max_ts, coalesce(n_events, 0) AS n_events, coalesce(n_list_events, 0) AS n_list_events FROM ev_r FULL JOIN ev_l USING (board_id, run)),
iv AS (SELECT board_id, run, max_ts AS first_ts, coalesce(lag(min_ts) OVER (PARTITION BY board_id ORDER BY run), t1) AS last_ts FROM red JOIN board USING (board_id)),
dist AS (SELECT board_id, run, n_events, date_diff('microsecond', coalesce(lead(max_ts) OVER (PARTITION BY board_id ORDER BY run), t0), min_ts) / 1e6 AS seconds FROM red JOIN board USING (board_id)),
gaps AS (SELECT board_id, run, round(date_diff('microsecond', first_ts, last_ts) / nullif(life, 0), 6) AS gap FROM iv JOIN board USING (board_id))
"""


def _describe(x: str, of: str = "") -> str:
    x = f"CAST({x} AS DOUBLE)"
    stats = {"mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)", "p75": f"quantile_cont({x}, 0.75)", "max": f"max({x})"}
    return ", ".join([f"count({x}) AS {of}n", *[f"round({v}, 6) AS {of}{k}" for k, v in stats.items()]])


EVOLUTION = """, le AS (SELECT * FROM e WHERE l IS NOT NULL AND list_id IS NOT NULL),
nm AS (SELECT board_id, list_id, string_agg(coalesce(list_name, '<null>'), '|' ORDER BY d DESC, i DESC) AS names, count(*) AS n_names FROM
  (SELECT board_id, list_id, list_name, max(date) AS d, max(id) AS i FROM le GROUP BY ALL) GROUP BY board_id, list_id),
ev AS (SELECT board_id, list_id, begin_date, CASE WHEN lastl IN ('list_ends', 'list_move') THEN last ELSE t1 END AS last_date, last_name, names, n_names FROM (
  SELECT board_id, list_id, min(date) AS begin_date, max(date) AS last, first(l ORDER BY date DESC, id DESC) AS lastl,
         first(list_name ORDER BY date DESC, id DESC) FILTER (WHERE list_name IS NOT NULL) AS last_name FROM le GROUP BY ALL)
  JOIN board USING (board_id) JOIN nm USING (board_id, list_id))
"""
CATEGORIES = f"""count(*) FILTER (WHERE id IS NOT NULL) AS events, count(*) FILTER (WHERE type IN {LISTS}) AS list_creation,
count(*) FILTER (WHERE type IN ('createCard', 'copyCard')) AS card_creation, count(*) FILTER (WHERE list_before_id IS NOT NULL) AS card_movement,
count(*) FILTER (WHERE card_closed) AS card_closed, count(*) FILTER (WHERE type IN {ACTIONS}) AS card_action"""


def _bins(n: int) -> str:
    return f""", bn AS (SELECT log.*, least(greatest(ceil(date_diff('microsecond', t0, date) * {n} / nullif(life, 0)), 1), {n})::INT AS bin FROM log JOIN board USING (board_id)),
ab AS (SELECT board_id, unnest(range(1, {n + 1}))::INT AS bin FROM board)
"""


def _evolution(n: int, where: str = "true") -> str:
    names = "events list_creation card_creation card_movement card_closed card_action".split()
    return f"{BASE}{_bins(n)}, k AS (SELECT board_id, bin, {CATEGORIES} FROM bn WHERE {where} GROUP BY ALL) SELECT board_id, bin, {', '.join(f'coalesce({c}, 0) AS {c}' for c in names)} FROM ab LEFT JOIN k USING (board_id, bin)"


def _shares_by(key: str, label: str, threshold: int = 0) -> str:
    return f"{BASE}, n AS (SELECT board_id, {key} AS list_name, count(id) AS n FROM e WHERE c = '{label}' AND {key} IS NOT NULL GROUP BY ALL HAVING count(id) > {threshold}) SELECT board_id, list_name, round(n / sum(n) OVER (PARTITION BY board_id), 6) AS share FROM n"


def _shares(label: str, threshold: int = 0) -> str:
    return f"""{BASE}, n AS (SELECT board_id, list_id, count(id) AS n FROM e WHERE c = '{label}' AND list_id IS NOT NULL GROUP BY ALL HAVING count(id) > {threshold})
SELECT board_id, list_id, name AS list_name, round(n / sum(n) OVER (PARTITION BY board_id), 6) AS share FROM n LEFT JOIN names USING (board_id, list_id)"""


def _graph(keys: str = "board_id", rows: str = "e", key: str = "list_id", before: str = "list_before_id", after: str = "list_after_id", threshold: int = 0) -> str:
    having = f"HAVING count(card_id) > {threshold}" if threshold else ""
    return f""", ed AS (SELECT {keys}, {after} AS a, {before} AS b FROM {rows} WHERE {after} IS NOT NULL AND {before} IS NOT NULL GROUP BY ALL {having}),
nd AS (SELECT {keys}, {key} AS node FROM {rows} WHERE {key} IS NOT NULL UNION SELECT {keys}, a FROM ed UNION SELECT {keys}, b FROM ed),
rc AS (SELECT {keys}, node AS x, node AS y FROM nd UNION
       SELECT {", ".join(f"rc.{k.strip()}" for k in keys.split(","))}, rc.x, s.y FROM rc JOIN (SELECT {keys}, a AS x, b AS y FROM ed UNION SELECT {keys}, b, a FROM ed) s
       ON {" AND ".join(f"rc.{k.strip()} = s.{k.strip()}" for k in keys.split(","))} AND rc.y = s.x),
lb AS (SELECT {keys}, x AS node, min(y) AS comp_id FROM rc GROUP BY ALL),
ar AS (SELECT {keys}, {after} AS node, count(id) AS n FROM {rows} WHERE {after} IS NOT NULL GROUP BY ALL),
comp AS (SELECT {keys}, comp_id, string_agg(node, '|' ORDER BY node) AS members, count(*) AS size, coalesce(sum(n), 0)::BIGINT AS n_moves_in FROM lb LEFT JOIN ar USING ({keys}, node) GROUP BY {keys}, comp_id)
"""


def _metrics(keys: str = "board_id", rows: str = "e") -> str:
    mean = lambda name, where, by: f"""(SELECT {keys}, round(avg(n), 6) AS {name} FROM (SELECT {keys}, {by}, count(id) AS n FROM {rows} WHERE {where} AND {by} IS NOT NULL GROUP BY ALL) GROUP BY {keys})"""
    return f""", mv AS (SELECT {keys}, list_id, count(*) AS n FROM (SELECT {keys}, list_before_id AS list_id FROM {rows} WHERE c = 'card_move' UNION ALL SELECT {keys}, list_after_id FROM {rows} WHERE c = 'card_move') WHERE list_id IS NOT NULL GROUP BY ALL),
al AS (SELECT {keys}, count(DISTINCT x) AS n FROM (SELECT {keys}, unnest([list_id, list_before_id, list_after_id]) AS x FROM {rows}) GROUP BY {keys}),
cd AS (SELECT {keys}, count(*) AS events, count(DISTINCT card_id) AS cards, count(DISTINCT list_id) AS lists,
       round(count(DISTINCT card_id) FILTER (WHERE list_before_id IS NOT NULL) / nullif(count(DISTINCT card_id), 0), 6) AS cards_moving_perc,
       round(count(DISTINCT card_id) FILTER (WHERE c = 'card_act') / nullif(count(DISTINCT card_id), 0), 6) AS cards_act_perc,
       round(count(DISTINCT card_id) FILTER (WHERE card_closed) / nullif(count(DISTINCT card_id), 0), 6) AS cards_closed_perc FROM {rows} GROUP BY {keys}),
ml AS (SELECT {keys}, round(avg(n), 6) AS move_per_list_with_move, count(*) AS moving FROM mv GROUP BY {keys}),
met AS (SELECT *, round(coalesce(moving, 0) / nullif(al.n, 0), 6) AS list_with_move_perc FROM cd LEFT JOIN al USING ({keys}) LEFT JOIN ml USING ({keys})
  LEFT JOIN {mean("moves_per_moving_card", "c = 'card_move'", "card_id")} USING ({keys}) LEFT JOIN {mean("act_per_list", "c = 'card_act'", "list_id")} USING ({keys})
  LEFT JOIN {mean("act_per_act_card", "c = 'card_act'", "card_id")} USING ({keys}))
"""


MOVE = "move_per_list_with_move, list_with_move_perc, cards_moving_perc, moves_per_moving_card"
ACT = "cards_act_perc, act_per_list, act_per_act_card"
CONNECTED = "SELECT {0}, count(*) AS list_num_components, round(avg(size), 6) AS list_connected_size_mean, round(avg(size) / sum(size), 6) AS list_connected_size_mean_perc, count(*) FILTER (WHERE n_moves_in > 0) AS list_num_components_move FROM comp GROUP BY {0}"
NODE = "SELECT {0}, events, cards, lists, list_num_components, list_connected_size_mean, list_connected_size_mean_perc, list_num_components_move, " + MOVE + ", " + ACT + ", cards_closed_perc FROM met LEFT JOIN (" + CONNECTED + ") USING ({0})"
TRANSITIONS = "SELECT board_id, {0} AS src, {1} AS dst, count(id) AS n FROM e WHERE {0} IS NOT NULL AND {1} IS NOT NULL GROUP BY ALL"
BY_ID = ", tr AS (SELECT t.board_id, a.name AS src, b.name AS dst, n FROM (" + TRANSITIONS.format("list_before_id", "list_after_id") + ") t LEFT JOIN names a ON a.board_id = t.board_id AND a.list_id = src LEFT JOIN names b ON b.board_id = t.board_id AND b.list_id = dst)"
PRECEDENCE = f"{BASE}{BY_ID} SELECT board_id, src, dst, n, round(n / moves, 6) AS share FROM tr JOIN (SELECT board_id, count(*) AS moves FROM e WHERE c = 'card_move' GROUP BY board_id) USING (board_id) WHERE n / moves > 0.05"
HELD = ["id", "date", "member_id", "type", "card_id", "card_closed", "card_due", "list_id", "list_name", "list_closed", "old_name", "list_before_id", "list_before_name", "list_after_id", "list_after_name"]
SUMMARY = f""", fs AS (SELECT board_id, count(*) AS events, ({" + ".join(f"(count({c}) > 0)::BIGINT" for c in HELD)}) AS attributes, count(DISTINCT card_id) AS cards, count(DISTINCT list_id) AS lists, count(DISTINCT member_id) AS members,
 min(date) FILTER (WHERE type = 'createList') AS first_list, max(date) FILTER (WHERE type = 'createList') AS last_list,
 count(*) FILTER (WHERE type = 'updateList' AND old_name IS NOT NULL) AS list_renames, count(*) FILTER (WHERE list_closed) AS closed_lists,
 count(*) FILTER (WHERE card_closed) AS closed_cards, count(*) FILTER (WHERE type = 'updateCard' AND list_before_id IS NOT NULL) AS movements, count(card_due) AS due_dates,
 count(*) FILTER (WHERE type = 'addMemberToCard') AS assignments, count(*) FILTER (WHERE type = 'addChecklistToCard') AS checklists, count(*) FILTER (WHERE type = 'deleteCard') AS deleted_cards,
 min(date) AS start, max(date) AS "end", date_diff('microsecond', min(date), max(date)) / 1e6 AS duration_s, first(type ORDER BY date, id DESC) AS first_type FROM log GROUP BY board_id)
"""
RED = BASE + _redesigns()
IN_RUN = ", ev AS MATERIALIZED (SELECT e.*, run FROM e JOIN iv ON e.board_id = iv.board_id AND e.date BETWEEN first_ts AND last_ts)"
LONG_RUN = """, in_run AS (SELECT e.*, run FROM e JOIN iv ON e.board_id = iv.board_id AND e.date BETWEEN first_ts AND last_ts WHERE date_diff('microsecond', first_ts, last_ts) >= 86400000000),
ev AS MATERIALIZED (SELECT * FROM in_run QUALIFY count(*) OVER (PARTITION BY board_id, run) >= 40)"""
DAILY = "SELECT board_id, CAST(date AS DATE) AS day, c, coalesce(list_comb, '##UNKNOWN') AS list_comb, count(*) AS n FROM e WHERE c IN ('card_act', 'card_create')"
RED_DAY = BASE + _redesigns(flag="le OR date < min(date) OVER (PARTITION BY board_id, seg) + INTERVAL 1 DAY")
RED_3_DAYS = BASE + _redesigns(flag="le OR date < min(date) OVER (PARTITION BY board_id, seg) + INTERVAL 3 DAY")
pc = "round(count(DISTINCT card_id) FILTER (WHERE {}) / nullif(count(DISTINCT card_id), 0), 6) AS {}".format

CORPUS_COLUMNS = ["events", "cards", "lists", "cards_moving_perc", "cards_closed_perc"]
CORPUS = f"""{BASE}{SUMMARY}, sh AS (SELECT board_id, {pc('list_before_id IS NOT NULL', 'cards_moving_perc')}, {pc('card_closed', 'cards_closed_perc')} FROM log GROUP BY board_id),
cx AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM fs JOIN sh USING (board_id)" for c in CORPUS_COLUMNS)}),
cd_x AS (SELECT metric, {_describe('value')} FROM cx GROUP BY metric)
"""

KEYS = {"pos": "pos", "id": "id", "type": "type", "date": "date", "idMemberCreator": "member_id", "data.board.id": "board_id", "data.card.id": "card_id", "data.card.closed": "card_closed", "data.card.due": "card_due", "data.list.id": "list_id", "data.list.name": "list_name", "data.list.closed": "list_closed",
        "data.listBefore.id": "list_before_id", "data.listBefore.name": "list_before_name", "data.listAfter.id": "list_after_id", "data.listAfter.name": "list_after_name", "data.old.name": "old_name"}
ATTRIBUTES = f"{BASE}" + " UNION ALL ".join(f"SELECT board_id::VARCHAR AS board_id, '{key}' AS path, count({column}) AS n FROM log GROUP BY board_id HAVING count({column}) > 0" for key, column in KEYS.items())
READ_BACK = f"{BASE} SELECT board_id::VARCHAR AS board_id, id::VARCHAR AS id, member_id::VARCHAR AS member_id, type, date, card_id, card_closed, list_id, list_name, list_closed, list_before_id, list_before_name, list_after_id, list_after_name, old_name FROM log"
SQL: dict[str, str] = {
    "enrich": f"{BASE} SELECT board_id, id, l, c, list_comb, list_before_comb, list_after_comb FROM e",
    "label_list_events": f"{BASE} SELECT board_id, id, l FROM e",
    "label_card_events": f"{BASE} SELECT board_id, id, c FROM e",
    "list_comb": f"{BASE} SELECT board_id, id, list_comb FROM e",
    "board_summary": f"{BASE}{SUMMARY} SELECT * FROM fs",
    "first_event_type": f"{BASE}{SUMMARY} SELECT board_id, first_type FROM fs",
    "events_per_member": f"{BASE} SELECT board_id, {_describe('k')} FROM (SELECT board_id, member_id, count(*) AS k FROM log WHERE member_id IS NOT NULL GROUP BY ALL) GROUP BY board_id",
    "type_histogram": f"{BASE} SELECT board_id, type, count(*) AS n FROM log GROUP BY ALL",
    "card_percentages": f"{BASE} SELECT board_id, {pc('list_before_id IS NOT NULL', 'moving')}, {pc('type = ' + repr('addChecklistToCard'), 'checklist')}, {pc('type = ' + repr('addMemberToCard'), 'assigned')}, {pc('card_closed', 'closed')} FROM log GROUP BY board_id",
    "list_names": f"{BASE} SELECT board_id, list_id, string_agg(coalesce(list_name, '<null>'), '|' ORDER BY d DESC) AS names FROM (SELECT board_id, list_id, list_name, max(date) AS d FROM log WHERE list_id IS NOT NULL GROUP BY ALL) GROUP BY board_id, list_id",
    "list_name_map": f"{BASE} SELECT * FROM names",
    "comb_collision": f"{BASE} SELECT board_id, count(DISTINCT substr(list_id, 19, 6)) <> count(DISTINCT list_id) AS collision FROM log GROUP BY board_id",
    "first_type_counts": f"{BASE}{SUMMARY} SELECT first_type, count(*) AS n FROM fs GROUP BY first_type",
    "corpus_describe": f"{CORPUS} SELECT * FROM cd_x",
    "corpus_describe_of_created": CORPUS.replace("JOIN sh USING (board_id)", "JOIN sh USING (board_id) WHERE first_type = 'createBoard'") + " SELECT * FROM cd_x",
    "board_selection_by_first_type": f"{BASE}{SUMMARY} SELECT board_id, events, duration_s FROM fs WHERE events > 300 AND duration_s > 7 * 86400 AND first_type = 'createBoard'",
    "board_selection": f"{BASE}{SUMMARY} SELECT board_id, events, duration_s FROM fs WHERE events > 300 AND duration_s > 7 * 86400",
    "list_evolution": f"{BASE}{EVOLUTION} SELECT board_id, list_id, begin_date, last_date, last_name, names FROM ev",
    "list_evolution_filtered": f"{BASE}{EVOLUTION} SELECT board_id, list_id, begin_date, last_date, last_name, names FROM ev WHERE last_date - begin_date > INTERVAL 25 DAY",
    "board_evolution": _evolution(30),
    "board_evolution_of_list": _evolution(10, "list_name = 'L2'"),
    "board_evolution_by_list": f"{BASE}{_bins(30)}, k AS (SELECT board_id, list_name, bin, count(*) AS n FROM bn WHERE type IN {ACTIONS} AND list_name IS NOT NULL GROUP BY ALL) SELECT board_id, list_name, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT board_id, list_name FROM k) JOIN ab USING (board_id) LEFT JOIN k USING (board_id, list_name, bin)",
    "daily_card_activity": f"{BASE} {DAILY} GROUP BY ALL",
    "daily_card_activity_between": f"{BASE} {DAILY} AND CAST(date AS DATE) > DATE '2024-01-05' AND CAST(date AS DATE) < DATE '2024-01-09' GROUP BY ALL",
    "card_activity": f"{BASE} SELECT board_id, date, c, coalesce(list_comb, '##UNKNOWN') AS list_comb FROM e WHERE c IN ('card_act', 'card_create', 'card_move', 'card_close')",
    "card_time_histogram": f"{BASE}, ce AS (SELECT board_id, date, c FROM e WHERE c IS NOT NULL), cb AS (SELECT board_id, min(date) AS t0, date_diff('microsecond', min(date), max(date)) AS life FROM ce GROUP BY board_id) SELECT board_id, c, least(greatest(coalesce(ceil(date_diff('microsecond', t0, date) * 30 / nullif(life, 0)), 1), 1), 30)::INT AS bin, count(*) AS n FROM ce JOIN cb USING (board_id) GROUP BY ALL",
    "list_timeline": f"{BASE}{EVOLUTION} SELECT board_id, list_id, row_number() OVER (PARTITION BY board_id ORDER BY last_date, list_id) - 1 AS place, begin_date, last_date, last_name FROM ev",
    "redesign_lines": f"{RED} SELECT board_id, run, 'min' AS edge, min_ts AS date FROM red UNION ALL SELECT board_id, run, 'max', max_ts FROM red",
    "redesigns": f"{RED} SELECT * FROM red",
    "redesigns_by_count": f"{BASE}{_redesigns(flag='le OR count(id) OVER (PARTITION BY board_id, seg) < 250')} SELECT * FROM red",
    "redesigns_of_class": f"{BASE}{_redesigns(le='l IN ' + repr(('list_create', 'list_rename')))} SELECT * FROM red",
    "redesigns_of_class_by_count": f"{BASE}{_redesigns(le='l = ' + repr('list_change'), flag='le OR count(id) OVER (PARTITION BY board_id, seg) < 600')} SELECT * FROM red",
    "redesigns_min_events": f"{RED_3_DAYS} SELECT * FROM red WHERE n_list_events > 1",
    "stable_intervals": f"{RED} SELECT * FROM iv",
    "redesign_distance": f"{RED} SELECT * FROM dist",
    "relative_gaps": f"{RED} SELECT * FROM gaps",
    "gap_describe": f"{RED} SELECT board_id, {_describe('gap')} FROM gaps GROUP BY board_id",
    "corpus_study": f"{RED_DAY}{SUMMARY}, sel AS (SELECT board_id FROM fs WHERE events > 300 AND duration_s > 7 * 86400) SELECT board_id, {_describe('gap')} FROM gaps JOIN sel USING (board_id) GROUP BY board_id",
    "corpus_study_of_created": f"{RED_DAY}{SUMMARY}, sel AS (SELECT board_id FROM fs WHERE events > 300 AND duration_s > 7 * 86400 AND first_type = 'createBoard') SELECT board_id, {_describe('gap')} FROM gaps JOIN sel USING (board_id) GROUP BY board_id",
    "gap_mean_of_means": f"{RED} SELECT round(avg(m), 6) AS mean_gap FROM (SELECT avg(gap) AS m FROM gaps GROUP BY board_id)",
    "interval_slice": f"{RED} SELECT log.board_id, id, type, date FROM log JOIN iv ON log.board_id = iv.board_id AND run = 2 AND date > first_ts AND date < last_ts",
    "lifetime_deciles": f"{RED}, b AS (SELECT board_id, floor(date_diff('microsecond', t0, min_ts) * 10 / nullif(life, 0)) AS bin FROM red JOIN board USING (board_id)) SELECT board_id, {', '.join(f'count(*) FILTER (WHERE bin = {k}) AS d{k}' for k in range(10))} FROM b GROUP BY board_id",
    "redesign_histogram": f"{RED} SELECT least(floor(n / 25) * 25, 275)::BIGINT AS bin_start, count(*) AS boards FROM (SELECT board_id, count(*) AS n FROM red GROUP BY board_id HAVING count(*) <= 300) GROUP BY 1",
    "transitions": f"{BASE} {TRANSITIONS.format('list_before_name', 'list_after_name')}",
    "transitions_by_id": f"{BASE}{BY_ID} SELECT * FROM tr",
    "transitions_by_comb": f"{BASE} {TRANSITIONS.format('list_before_comb', 'list_after_comb')}",
    "transitions_pivot": f"{BASE} SELECT board_id, src, {', '.join(f'CAST(sum(n) FILTER (WHERE dst = {repr(k)}) AS BIGINT) AS {k}' for k in ('L0', 'L1', 'L2', 'L3'))} FROM ({TRANSITIONS.format('list_before_name', 'list_after_name')}) GROUP BY board_id, src",
    "semantic_precedence": PRECEDENCE,
    "create_lists": _shares("card_create"),
    "close_lists": _shares("card_close"),
    "use_lists": _shares("card_act", 20),
    "use_lists_by_comb": _shares_by("list_comb", "card_act", 20),
    "create_lists_by_name": _shares_by("list_name", "card_create"),
    "precedence_by_name": f"{BASE} SELECT board_id, src, dst, n, round(n / moves, 6) AS share FROM ({TRANSITIONS.format('list_before_name', 'list_after_name')}) JOIN (SELECT board_id, count(*) AS moves FROM e WHERE c = 'card_move' GROUP BY board_id) USING (board_id) WHERE n / moves > 0.05",
    "event_log": f"{BASE} SELECT card_id AS case_id, coalesce(list_after_name, CASE WHEN card_closed THEN '**Closed' ELSE list_name END) AS activity, date AS ts, member_id AS resource, type, coalesce(card_closed, false) AS closed, coalesce(list_before_name, '') AS src, coalesce(list_after_name, '') AS dst, board_id FROM e WHERE c IN ('card_create', 'card_close', 'card_move')",
    "moves_per_list": f"{BASE}{_metrics()} SELECT * FROM mv",
    "components": f"{BASE}{_graph()} SELECT * FROM comp",
    "components_by_comb": f"{BASE}{_graph(key='list_comb', before='list_before_comb', after='list_after_comb')} SELECT * FROM comp",
    "components_threshold": f"{BASE}{_graph(threshold=55)} SELECT * FROM comp",
    "design_lists": f"{BASE}{_graph()} SELECT lb.board_id, coalesce(name, node) AS list FROM lb LEFT JOIN names ON lb.board_id = names.board_id AND node = list_id",
    "design_card_flow": f"{BASE}{_graph()} SELECT lb.board_id, comp_id, string_agg(DISTINCT coalesce(name, node), '|' ORDER BY coalesce(name, node)) AS members FROM lb LEFT JOIN names ON lb.board_id = names.board_id AND node = list_id GROUP BY ALL",
    "design_lists_by_comb": f"{BASE}{_graph(key='list_comb', before='list_before_comb', after='list_after_comb')} SELECT board_id, node AS list FROM lb",
    "design_precedence": PRECEDENCE,
    "move_metrics": f"{BASE}{_metrics()} SELECT board_id, {MOVE} FROM met",
    "act_metrics": f"{BASE}{_metrics()} SELECT board_id, {ACT} FROM met",
    "close_metrics": f"{BASE}{_metrics()} SELECT board_id, cards_closed_perc FROM met",
    "connected_metrics": f"{BASE}{_graph()} {CONNECTED.format('board_id')}",
    "redesign_metrics": f"{RED} SELECT board_id, {_describe('n_events', 'size_')}, {_describe('seconds', 'distance_')}, round(avg(seconds) / 86400, 6) AS distance_mean_days FROM dist GROUP BY board_id",
    "list_evolution_metrics": f"{BASE}{EVOLUTION}, x AS (SELECT board_id, date_diff('microsecond', begin_date, last_date) AS own, n_names, life FROM ev JOIN board USING (board_id)) SELECT board_id, round(avg(own / 1e6), 6) AS list_duration_s, {_describe('(own / nullif(life, 0))', 'share_')}, round(avg(n_names), 6) AS list_renames_mean FROM x GROUP BY board_id",
    "static_metrics": f"{BASE}{_graph()}{_metrics()} {NODE.format('board_id')}",
    "static_metrics_by_interval": f"{RED}{IN_RUN}{_graph('board_id, run', 'ev')}{_metrics('board_id, run', 'ev')} {NODE.format('board_id, run').replace('events, cards', 'first_ts, last_ts, events, cards')} JOIN iv USING (board_id, run)",
    "static_metrics_of_long_intervals": f"{RED}{LONG_RUN}{_graph('board_id, run', 'ev')}{_metrics('board_id, run', 'ev')} {NODE.format('board_id, run').replace('events, cards', 'first_ts, last_ts, events, cards')} JOIN iv USING (board_id, run)",
    "paged_log": READ_BACK,
    "refreshed_log": READ_BACK,
    "redesigns_stream": f"{RED}, nth AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY run DESC) AS nth FROM red), ends AS (SELECT board_id, run + 1 AS run, min(date) AS closed FROM r5 WHERE NOT r GROUP BY board_id, run) SELECT board_id, nth, min_ts, max_ts, n_events, n_list_events FROM nth JOIN ends USING (board_id, run) WHERE closed <= (SELECT date_trunc('millisecond', max(date)) FROM log) - INTERVAL 1 DAY",
    "attribute_counts": ATTRIBUTES,
    "csv_log": READ_BACK,
    "xes_log": f"{BASE} SELECT board_id::VARCHAR AS board_id, card_id AS case_id, coalesce(list_after_name, CASE WHEN card_closed THEN '**Closed' ELSE list_name END) AS activity, date AS ts, member_id::VARCHAR AS resource, type, coalesce(card_closed, false) AS closed, coalesce(list_before_name, '') AS src, coalesce(list_after_name, '') AS dst FROM e WHERE c IN ('card_create', 'card_close', 'card_move')",
    "activity_stream": f"{BASE} SELECT * FROM (SELECT board_id, c, date_trunc('hour', date) AS hour, count(*) AS n FROM e WHERE c IS NOT NULL GROUP BY 1, 2, 3) WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(date)) FROM log) - INTERVAL 2 DAY",
    "distincts": f"{BASE} SELECT board_id, count(DISTINCT card_id) AS cards, count(DISTINCT list_id) AS lists, count(DISTINCT member_id) AS members FROM log GROUP BY board_id",
    "distincts_by_week": f"{BASE} SELECT board_id, date_trunc('week', date)::DATE AS period, count(DISTINCT card_id) AS cards, count(DISTINCT list_id) AS lists, count(DISTINCT member_id) AS members FROM log GROUP BY 1, 2",
}
