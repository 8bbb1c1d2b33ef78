"""The registered queries in SQL, written from the rules and not from the Spark plans.

Sequential rules are recursive queries or list folds here, one step at a time.
"""

from __future__ import annotations

from poolwright.functions.text import WHITE_SPACE
from poolwright.operators import extraction as ex
from poolwright.operators import grounding as gr

WS = WHITE_SPACE
JOBS_NOW = 1_706_600_000
NOW = 1_704_200_000


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), {q(WS)})"


def clip(x: str, n: int) -> str:
    """The longest prefix of at most n bytes."""
    return (
        f"(select case when strlen(_c) <= {n} then _c else left(_c, list_max(list_filter(range({n // 4}, {n} + 1), "
        f"lambda k: strlen(left(_c, k)) <= {n}))) end from (select {trim(x)} as _c))"
    )


def paragraphs(x: str, delimiter: str = "chr(10)") -> str:
    return f"[{trim('p')} for p in string_split({x}, {delimiter}) if {trim('p')} <> '']"


def terms(x: str) -> str:
    return f"list_distinct([w for w in regexp_split_to_array(lower({x}), '[^a-z0-9]+') if len(w) >= 3])"


K = "json_extract_string(props, '$.k')::int"
SECONDS = "floor(epoch(ts))::bigint"

POOL = """pool as (
  select d.source pool_id, d.doc_id seq, d.doc_id, 'doc ' || d.doc_id title,
    case when l.quality is not null or d.lang in ('fr', 'es') then 'file' else 'text' end kind,
    case when l.quality = 1 then 'ready' when l.quality = 0 then 'failed' when d.lang = 'fr' then 'pending' else '' end state,
    1700000000 + d.n_chars % 1000 created, d.text
  from documents d left join labels l using (doc_id))"""

QUESTIONS = f"""question as (
  select item_id question_id, 'src' || (item_id % 20) pool_id, {terms('text')} terms from benchmark)"""

SCORED = f"""para as (
  select doc_id, doc_id % (select count(*) from benchmark) question_id, unnest(ps) para, unnest(range(len(ps))) idx
  from (select doc_id, {paragraphs('text')} ps from documents)),
{QUESTIONS},
scored as (
  select question_id, doc_id, idx, strlen(para) bytes,
    len(list_filter(terms, lambda t: contains(lower(para), t))) score
  from para join question using (question_id)),
ranked as (
  select *, row_number() over (partition by question_id, doc_id order by score desc, idx) place from scored)"""


def pick_walk(source: str, keys: str, budget: int) -> str:
    """Greedy selection, one ranked paragraph per step."""
    on = " and ".join(f"w.{k} = r.{k}" for k in keys.split(", "))
    mine = ", ".join(f"w.{k}" for k in keys.split(", "))
    fits = f"w.used + r.bytes + (case when w.used > 0 then 2 else 0 end) <= {budget}"
    return f"""walk as (
  select distinct {keys}, 0::bigint place, 0::bigint used, []::bigint[] chosen from {source}
  union all
  select {mine}, r.place,
    case when {fits} then w.used + r.bytes + (case when w.used > 0 then 2 else 0 end) else w.used end,
    case when {fits} then list_append(w.chosen, r.idx) else w.chosen end
  from walk w join {source} r on {on} and r.place = w.place + 1),
picked as (
  select {keys}, arg_max(used, place) used, list_sort(arg_max(chosen, place)) chosen from walk group by {keys})"""


def packing(asked: bool, refs: bool | str) -> str:
    """Every unit's decision for every question, by walking each pool unit by unit."""
    question = QUESTIONS if asked else "question as (select distinct null::bigint question_id, source pool_id, []::varchar[] terms from documents)"
    ref = refs if isinstance(refs, str) else (
        """known as (
  select doc_id, 'text' part, -1 idx, 'ref-' || doc_id ref from labels where quality = 1 and toxic = 0
  union all select doc_id, 'image', 0, 'ref-' || doc_id from labels where toxic = 1)"""
        if refs
        else "known as (select 0::bigint doc_id, 'none' part, 0 idx, '' ref where false)"
    )
    acc = "{'used': 0::bigint, 'chosen': []::bigint[], 'idx': 0::bigint, 'bytes': 0::bigint}"
    step = (
        "list_reduce(rk.paras, lambda a, x: case when a.used + x.bytes + (case when a.used > 0 then 2 else 0 end) <= w.rest "
        "then {'used': a.used + x.bytes + (case when a.used > 0 then 2 else 0 end), 'chosen': list_append(a.chosen, x.idx), 'idx': 0::bigint, 'bytes': 0::bigint} "
        f"else a end, {acc})"
    )
    return f"""{POOL}, {question}, {ref},
unit0 as (
  select pool_id, seq, 0 sub, doc_id, 'text' part, -1 idx, title path, 'text/markdown' media_type,
    strlen({trim('text')}) bytes, state = 'ready' can_split
  from pool where (kind = 'text' or state = 'ready') and {trim('text')} <> ''
  union all
  select pool_id, seq, 0, doc_id, 'raw', -1, title, 'text/plain; charset=utf-8', strlen(text), false
  from pool where kind = 'file' and state = '' and strlen(text) > 0
  union all
  select pool_id, seq, 1 + i.idx, doc_id, 'image', i.idx,
    title || (case when i.idx > 0 then ' (image on page ' || (2 * i.idx) || ').jpg' else ' (image).jpg' end),
    'image/jpeg', 4 * ((i.size + 2) // 3), false
  from pool join (
    select doc_id, idx, n_chars % 400 + 30 * idx + 1 size
    from (select doc_id, n_chars, unnest(range(n_chars % 3)) idx from documents)) i using (doc_id)
  where state = 'ready' and {trim('text')} <> ''),
unit as (
  select u.*, k.ref, row_number() over (partition by pool_id order by seq, sub) pos
  from unit0 u left join known k
    on k.doc_id = u.doc_id and k.idx = u.idx and k.part = (case when u.part = 'image' then 'image' else 'text' end)),
para as (
  select doc_id, pool_id, unnest(ps) para, unnest(range(len(ps))) idx
  from (select doc_id, pool_id, {paragraphs('text')} ps from pool where state = 'ready')),
rk as (
  select question_id, doc_id, list({{'used': 0::bigint, 'chosen': []::bigint[], 'idx': idx::bigint, 'bytes': strlen(para)::bigint}} order by score desc, idx) paras
  from (select question_id, doc_id, idx, para, len(list_filter(terms, lambda t: contains(lower(para), t))) score
        from para join question using (pool_id))
  group by question_id, doc_id),
walk as (
  select question_id, pool_id, 0::bigint pos, 20000::bigint rest, '' decision, 0::bigint sent, []::bigint[] chosen from question
  union all
  select question_id, pool_id, pos, rest - got.used,
    case when got.decision = 'try' then (case when got.used > 0 then 'partial' else 'omitted' end) else got.decision end,
    got.used, list_sort(got.chosen)
  from (
    select w.question_id, w.pool_id, u.pos, w.rest,
      case when u.ref is not null then {{'decision': 'ref', 'used': 0::bigint, 'chosen': []::bigint[]}}
        when u.bytes <= w.rest then {{'decision': 'whole', 'used': u.bytes::bigint, 'chosen': []::bigint[]}}
        when u.can_split then (select {{'decision': 'try', 'used': g.used, 'chosen': g.chosen}} from (select {step} g))
        when u.part = 'image' then {{'decision': 'omitted_image', 'used': 0::bigint, 'chosen': []::bigint[]}}
        else {{'decision': 'omitted', 'used': 0::bigint, 'chosen': []::bigint[]}} end got
    from walk w join unit u on u.pool_id = w.pool_id and u.pos = w.pos + 1
    left join rk on rk.question_id is not distinct from w.question_id and rk.doc_id = u.doc_id and u.can_split)),
decided as (
  select w.question_id, w.pool_id, u.seq, u.sub, u.doc_id, u.part, u.idx, u.path, u.media_type, u.ref, w.decision, w.sent, w.chosen
  from walk w join unit u using (pool_id, pos)),
agreed as (
  select pool_id, seq, sub, count(distinct (decision, sent, chosen)) = 1 as same from decided group by pool_id, seq, sub),
packed as (
  select distinct case when same then null else question_id end question_id, pool_id, seq, sub, doc_id, part, idx, path, media_type, ref, decision, sent, chosen
  from decided join agreed using (pool_id, seq, sub)),
waiting as (
  select pool_id, seq, 0 sub, title path, case when state = 'failed' then 'unread' else 'not_read' end gap
  from pool where state in ('failed', 'pending')),
gap as (
  select question_id, pool_id, seq, sub, path, decision gap from packed where decision in ('omitted', 'omitted_image', 'partial')
  union all select null, * from waiting),
gap_each as (
  select question_id, seq, sub, path, decision gap from decided where decision in ('omitted', 'omitted_image', 'partial')
  union all select question_id, seq, sub, path, gap from waiting join question using (pool_id))"""


SHARED = "with recursive " + packing(True, False)
CONTENT = f"""content as (
  select s.question_id, s.seq, s.sub, s.path, s.media_type,
    case when part = 'image' then to_base64(encode(repeat('x', (n_chars % 400 + 30 * idx + 1)::int)))
      when decision = 'partial' then array_to_string(list_transform(list_sort(chosen), lambda k: ({paragraphs('d.text')})[k + 1]), chr(10) || chr(10))
      when part = 'raw' then d.text else {trim('d.text')} end c
  from sent s join documents d on d.doc_id = s.doc_id)"""
NO_QUESTION = "with recursive " + packing(False, False)


def grounded(known: str) -> str:
    """One row per question: counts of parts, references and bytes, its note, and the units sent in full."""
    sent = "decision in ('whole', 'partial', 'ref')"
    return f"""with recursive {packing(True, known)},
listed as (
  select question_id, gap, {GAP_ORDER} o, {GAP_TEXT} || string_agg(path, ', ' order by seq, sub) || '. ' t from gap_each group by question_id, gap),
note as (select question_id, {q(gr.NOTE_OPENING)} || string_agg(t, '' order by o) || {q(gr.NOTE_CLOSING)} note from listed group by 1),
total as (
  select question_id, count(*) n, count(*) filter (where part = 'image') pics, sum(sent) size, coalesce(sum(sent) filter (where part <> 'image'), 0) tsize,
    count(*) filter (where decision = 'ref') refs, count(*) filter (where decision = 'ref' and part <> 'image') trefs,
    list({{'doc_id': doc_id, 'part': case when part = 'image' then 'image' else 'text' end, 'idx': idx, 'path': path}}) filter (where decision <> 'partial') units,
    list(path) paths
  from decided where {sent} group by 1)
select question_id, coalesce(n, 0) n, coalesce(pics, 0) pics, coalesce(size, 0) size, coalesce(tsize, 0) tsize, coalesce(refs, 0) refs, coalesce(trefs, 0) trefs,
  units, case when note is null then 0 else 1 end noted, coalesce(strlen(note), 0) nsize, len({trim('text')}) len
from (select item_id question_id, text from benchmark) left join total using (question_id) left join note using (question_id)"""


def answered(source: str) -> str:
    """What the stand-in for a model says to each row of ``grounded``."""
    return f"""(select *, case when seen > 0 and len % 3 = 0 then 'stale reference' when len % 5 = 0 then 'unavailable' else '' end error,
    len || ':' || shown || ':' || bytes::bigint || ':' || seen said from (
  select *, pics > 0 and len % 2 = 1 blind, case when blind then trefs else refs end seen,
    case when blind then n - pics + 1 + noted else n + noted end shown,
    case when blind then tsize + strlen({q(gr.NO_VISION_NOTE)}) + nsize else size + nsize end bytes from {source}))"""


GAP_ORDER = "case gap when 'omitted' then 1 when 'omitted_image' then 2 when 'partial' then 3 when 'not_read' then 4 else 5 end"
GAP_TEXT = "case gap " + " ".join(f"when '{g}' then {q(t)}" for g, t in gr.NOTE_SENTENCES.items()) + " end"
UNITS = "select distinct u.doc_id, u.part, u.idx, 'r:' || u.path ref from (select blind, unnest(units) u from {0} where {1}) where not (blind and u.part = 'image')"
TURNS = f"""with recursive
g1 as materialized ({grounded("known as (select 0::bigint doc_id, 'none' part, 0 idx, '' ref where false)")}),
a1 as {answered('g1')},
ledger1 as materialized ({UNITS.format('a1', "error = ''")}),
g2 as materialized ({grounded("known as (select * from ledger1)")}),
a2 as {answered('g2')},
stale as (select distinct u.doc_id, u.part, u.idx from (select unnest(units) u from a2 where error <> '' and refs > 0)),
ledger2 as materialized (select * from ledger1 anti join stale using (doc_id, part, idx)),
g3 as materialized ({grounded("known as (select * from ledger2)")}),
a3 as {answered('g3')},
last as (
  select * from a2 where not (error <> '' and refs > 0)
  union all select * from a3 where question_id in (select question_id from a2 where error <> '' and refs > 0)),
new as (select * from (select question_id, error, said, n, pics, blind, units, 1 turn from a1 union all select question_id, error, said, n, pics, blind, units, 2 from last))"""
REFS = "with recursive " + packing(True, True)
REFS_NO_QUESTION = "with recursive " + packing(False, True)

STATE = f"""ev as (
  select user_id doc_id, ts, event_id, {K} k,
    case event_type when 'signup' then 'pending' when 'view' then 'reading' when 'error' then 'failed' else 'ready' end state,
    event_type, {SECONDS} sec from events),
folded as (
  select doc_id, arg_max(state, (ts, event_id)) state,
    coalesce(arg_max(case when event_type = 'click' then 'text-layer' else 'ai' end, (ts, event_id)) filter (where state = 'ready'), '') source,
    coalesce(arg_max('m' || (k % 5), (ts, event_id)) filter (where state = 'ready'), '') model,
    coalesce(arg_max('e' || (k % 3), (ts, event_id)) filter (where state = 'ready'), '') engine,
    coalesce(arg_max(case when state = 'failed' then 'error ' || k else '' end, (ts, event_id)) filter (where state in ('ready', 'failed')), '') error,
    coalesce(arg_max(k, (ts, event_id)) filter (where state = 'ready'), 0)::bigint size,
    coalesce(arg_max(sec, (ts, event_id)) filter (where state in ('ready', 'failed')), 0)::bigint "at",
    arg_max(case when state = 'pending' then false else k % 2 = 0 end, (ts, event_id)) text_layer,
    coalesce(arg_max(case when state = 'pending' then 0 else k % 7 end, (ts, event_id)) filter (where state <> 'failed' or k % 10 > 0), 0)::bigint done,
    coalesce(arg_max(case when state = 'pending' then 0 else k % 10 end, (ts, event_id)) filter (where state <> 'failed' or k % 10 > 0), 0)::bigint total,
    coalesce(arg_max(case when state = 'pending' then '' else 'page ' || k end, (ts, event_id)) filter (where state <> 'failed' or k % 10 > 0), '') label,
    arg_max(case when state in ('pending', 'failed') then '' when k % 3 = 0 then 'compressing' else 'reading' end, (ts, event_id)) phase
  from ev group by doc_id)"""

GRAPHS = f"""with ev as (
  select user_id graph_id, (ts, event_id) o, event_id, {K} k, {SECONDS} sec,
    case event_type when 'click' then 'ok' when 'signup' then 'empty' when 'error' then 'failed' when 'view' then 'manual' else 'restore' end kind
  from events),
g as (
  select graph_id, max(o) filter (where kind = 'manual') p, max(o) filter (where kind = 'restore') r,
    arg_max('graph ' || event_id, o) filter (where kind = 'ok') doc,
    arg_max('graph ' || event_id, o) filter (where kind = 'manual') drawn,
    arg_max('key ' || k, o) filter (where kind = 'ok') source_key,
    arg_max(sec, o) filter (where kind = 'ok') generated,
    arg_max({{'kind': kind, 'note': 'note ' || k, 'model': 'm' || (k % 5), 'engine': 'e' || (k % 3), 'at': sec}}, o) filter (where kind in ('ok', 'empty', 'failed')) l
  from ev group by graph_id),
m as (select *, p is not null and (r is null or p > r) modified from g)
select graph_id, coalesce(doc, '') doc, coalesce(case when modified then drawn else doc end, '') as "current", modified,
  case when modified then 'manual' else 'document' end state, coalesce(source_key, '') source_key, coalesce(generated, 0)::bigint generated,
  coalesce(l.kind, '') generation, coalesce(l.note, '') note, coalesce(l.model, '') model, coalesce(l.engine, '') engine,
  coalesce(l."at", 0)::bigint generation_at from m"""

LINES = """line as (
  select l_suppkey doc_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) page, * from lineitem)"""


def page_packing(budget: int) -> str:
    """Pages one at a time: where does the section of each page start?"""
    joins = f"w.n > 0 and w.n < 12 and w.size + p.bytes <= {budget} and p.bytes <= {budget} and w.size <= {budget}"
    return f"""with recursive {LINES},
p as (select doc_id, page, l_quantity::bigint bytes from line),
walk as (
  select doc_id, page, page first_page, 1 n, bytes size from p where page = 1
  union all
  select p.doc_id, p.page, case when {joins} then w.first_page else p.page end,
    case when {joins} then w.n + 1 else 1 end, case when {joins} then w.size + p.bytes else p.bytes end
  from walk w join p on p.doc_id = w.doc_id and p.page = w.page + 1)
select doc_id, first_page, max(page) last_page, max(size)::bigint bytes, max(size) > {budget} too_big,
  case when count(*) = 1 then 'page ' || first_page else 'pages ' || first_page || '–' || max(page) end label
from walk group by doc_id, first_page"""


IMAGES = f"""{LINES},
img as (
  select doc_id, l_partkey "object", min(((page - 1) // 4 + 1, (page - 1) % 4)) f from line group by 1, 2),
image as (select doc_id, "object", f[1] page, f[2] place from img)"""

SECTIONS = f"""{LINES},
s as (
  select doc_id, page - 1 idx, page,
    case when p_size = 1 then '[an embedded image could not be read (an unsupported image format)]'
      when p_size = 2 then '[page ' || page || ': too large to read in one request — this part was not read]'
      when not (l_returnflag = 'N' or p_size > 25) then '[page ' || page || ': could not be read: ' || (case when l_returnflag = 'R' then 'too slow' else 'unreadable' end) || ']'
      else (case when l_linestatus = 'O' then 'Image on page ' || page || ':' || chr(10) else '' end) || (case when p_size > 45 then ' ' else p_name end) end piece,
    p_size > 2 and (l_returnflag = 'N' or p_size > 25) as read, p_size, p_brand
  from line join part on p_partkey = l_partkey)"""

UPLOAD = """up as (
  select page_id // 25 batch, page_id ord,
    ' ' || regexp_replace(url, '\\?', chr(7), 'g') || ['.md', '.CSV', '.Markdown', ''][page_id % 4 + 1] "name",
    case when page_id % 17 = 3 then '' else
      ['', '89504E470D0A1A0A', '255044462D', 'FFD8FF', '474946383961', '0000'][page_id % 6 + 1] || hex(encode(html)) end hx
  from pages),
named as (
  select batch, ord, hx, len(hx) // 2 size,
    regexp_replace(case when base in ('', '.') then 'file' else base end, '[\\x00-\\x1F\\x7F]', '', 'g') "name"
  from (select *, regexp_extract(regexp_replace(trim("name"), '/+$', ''), '([^/]*)$', 1) base from up)),
kinded as (
  select *, case when ord % 17 = 3 or ord % 6 = 0 then
      (case when lower("name") like '%.md' or lower("name") like '%.markdown' then 'text/markdown' when lower("name") like '%.csv' then 'text/csv' else 'text/plain; charset=utf-8' end)
    else ['', 'image/png', 'application/pdf', 'image/jpeg', 'image/gif', ''][ord % 6 + 1] end mime
  from named),
told as (
  select *, case when mime = '' then 'files of type application/octet-stream can''t be read as room knowledge — upload an image, PDF, or text document' else '' end refusal
  from kinded)"""


#: The pages of a batch as one file, in hex.
STORED = """stored as (
  select batch, ['', '89504E470D0A1A0A', '255044462D', 'FFD8FF', '474946383961', '0000'][batch % 6 + 1]
    || string_agg(hex(encode(html)), '0A' order by page_id) || '0A' hx
  from (select page_id // 25 batch, page_id, html from pages) group by batch)"""


def judged(batch: str, most: int) -> str:
    return f"""{UPLOAD},
judged as (
  select {batch} batch, ord, "name", size, mime,
    case when row_number() over (partition by {batch} order by ord) > {most} then 'skipped — at most {most} files per upload'
      when size = 0 then 'the file is empty' when refusal <> '' then refusal
      when size > 4000 then 'is over the 0 MB limit for one file' else '' end reason from told)"""


NODES = """sup as (select 'n' || s_nationkey graph_id, s_suppkey, s_name, s_acctbal from supplier),
node0 as (
  select graph_id, s_suppkey ord, 's' || s_suppkey id, s_name "name", 'S' symbol, s_acctbal x, s_acctbal * 4 y from sup
  union all
  select distinct graph_id, p_partkey + 1000000,
    case p_partkey % 10 when 0 then '' when 1 then 'p1' else 'p' || p_partkey end, p_name, p_type,
    case when p_size = 7 then 'NaN'::double else p_retailprice * 15 end, p_size - 5.0
  from sup join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey),
node as (
  select graph_id, id, ord, left("name", 120) "name", trim(left(trim(symbol), 16)) symbol0, symbol,
    case when isnan(x) then 0.0 else least(greatest(x, 0), 20000) end x, least(greatest(y, 0), 20000) y
  from (select *, row_number() over (partition by graph_id, id order by ord) again
        from (select *, row_number() over (partition by graph_id order by ord) rn from node0) where rn <= 50 and id <> '')
  where again = 1),
port as (select graph_id, id node, unnest(['1', '2', '3']) id, unnest([0, 1, 3]) ord from node)"""

EDGES = """edge as (
  select graph_id, row_number() over (partition by graph_id order by l_shipdate, l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) ord, l_orderkey, 's' || l_suppkey from_node, l_linenumber::varchar from_port,
    'p' || l_partkey to_node, l_linenumber::varchar to_port, l_returnflag label
  from lineitem join sup on s_suppkey = l_suppkey),
edge_id as (select *, case when ord % 3 = 0 then '' else 'e' || (l_orderkey % 500) end id from edge)"""

TALK = f"""talk as (
  select conv_id "owner", turn, role, {trim('text')} t,
    case when role = 'assistant' then 'model ' || conv_id else '' end model,
    case when role = 'assistant' then 'engine' else '' end engine,
    (case when turn % 2 = 0 then {NOW} else 1700000000 + turn end)::bigint created
  from (select *, row_number() over (partition by conv_id order by turn desc) rn from conversations)
  where rn <= 5 and role in ('user', 'assistant') and {trim('text')} <> '')"""

PART_JSON = """ans as (
  select p_partkey graph_id, p_partkey % 6 c, p_name, p_brand, p_retailprice from part)"""


GONE = "(select user_id from events where event_type = 'error')"

ORACLES: dict[str, str] = {
    "load_pool_documents__o1": f"with {POOL} select pool_id, seq, doc_id, title, kind, state, strlen(text)::bigint size from pool",
    "read_uploaded_files__o2": f"with {UPLOAD} select batch, ord, (len(hx) // 2)::bigint size, md5(unhex(hx)) digest from up",
    "extract_view__o3": f"with {POOL} select pool_id, doc_id, title, state, md5(case when state = 'ready' then text else '' end) text_digest from pool where kind = 'file'",
    "apply_changes__o4": f"""with last as (
  select user_id doc_id, arg_max(event_type, (ts, event_id)) source, arg_max({K}, (ts, event_id))::bigint n_chars from events group by 1)
select doc_id, source, n_chars from documents where doc_id not in (select doc_id from last)
union all select doc_id, source, n_chars from last where source <> 'error'""",
    "replace_by_owner__o5": """with o as (select distinct conv_id from conversations where role = 'system')
select conv_id "owner", turn, role, text from conversations where conv_id not in (from o)
union all select conv_id, turn, role, 'new ' || text from conversations where conv_id in (from o) and role = 'user'""",
    "cascade_delete__o6": f"""select doc_id, 'text' kept_in from documents where doc_id not in {GONE}
union all select doc_id, 'label' from labels where doc_id not in {GONE}""",
    "read_stored_files__o2": f"with {STORED} select batch, (len(hx) // 2)::bigint size, md5(unhex(hx)) digest from stored",
    "upload_kind__o7": f"with {UPLOAD} select ord, mime, refusal reason from told",
    "text_type__o8": f"""with {UPLOAD} select ord, case when lower("name") like '%.md' or lower("name") like '%.markdown' then 'text/markdown'
  when lower("name") like '%.csv' then 'text/csv' else 'text/plain; charset=utf-8' end mime from up""",
    "clean_name__o9": f'with {UPLOAD} select ord, {clip("name", 120)} "name" from named',
    "clip_bytes__o11": f"select doc_id, {clip('text', 200)} clipped from documents",
    "with_ending__o13": """with m as (select page_id, url, ['.jpg', '.png', '.gif', '.webp', '.pdf', ''][page_id % 6 + 1] e from pages)
select page_id, url || (case when page_id % 12 < 6 then upper(e) else e end) "name" from m""",
    "coherent__o17": f"""with t as (
  select doc_id id, {trim('text')} t from documents
  union all select -1 - conv_id * 1000 - turn, {trim("replace(text, 'e', chr(1))")} from conversations)
select id, len(t) >= 16 and (len(t) - len(regexp_extract_all(t, '[\\x00-\\x08\\x0B-\\x1F\\x{{FFFD}}]')))::double / nullif(len(t), 0) >= 0.85 coherent from t""",
    "squeeze_blank_lines__o18": f"""with l as (
  select doc_id, [case when {trim('x')} = '' then '' else rtrim(x, {q(" " + chr(9) + chr(13))}) end for x in string_split(replace(text, '. ', {q(". " + chr(10) + chr(9) + chr(10) + " " + chr(10))}), chr(10))] ls from documents)
select doc_id, md5({trim("regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}) digest from l""",
    "strip_bom__o19": "select doc_id, md5(text) digest from documents",
    "error_kind__o21": f"""with t as (
  select 'd' "of", doc_id id, {trim('text')} t from documents union all select 'p', page_id, {trim('html')} from pages),
k as (
  select *, case when t = '' then 'empty' when t like '<%' or regexp_matches(t, '(?i)<!doctype|<html|<head|<body|cloudflare|error code\\s*[0-9]') then 'proxy' else 'message' end kind from t)
select "of", id, kind, md5(case kind when 'empty' then 'server error' when 'proxy' then 'server timeout' else t end) digest from k""",
    "permitted__o22": """select conv_id "owner", turn, role from conversations
where conv_id in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))""",
    "own_rows__o22": 'select conv_id "owner", turn, role from conversations where conv_id = 7',
    "failure_reasons__o23": f"""with c as (
  select l_orderkey doc_id, case when bool_or(l_returnflag = 'R' and l_quantity > 49) then 'too_big'
    when bool_or(l_returnflag = 'R') then 'too_slow' else 'nothing' end cause from lineitem group by 1)
select doc_id, cause, case cause when 'too_big' then {q(ex.NO_TEXT['too_big'])} when 'too_slow' then {q(ex.NO_TEXT['too_slow'])} else {q(ex.NO_TEXT['nothing'])} end reason from c""",
    "fold_events__o24": f"with {STATE} select * from folded where doc_id in (select doc_id from documents)",
    "to_resume__o25": f"""with {STATE} select doc_id, state from folded
where state in ('pending', 'reading') or (state = 'ready' and total > 0 and done < total)""",
    "last_text__o24": f"with {STATE} select doc_id, size bytes from folded where doc_id in (select user_id from events where event_type in ('click', 'purchase'))",
    "resume_kept__o24": f"""with {STATE} select distinct l_suppkey doc_id, l_linenumber::bigint idx from lineitem
where l_suppkey not in (select doc_id from folded where state = 'ready' and done >= total)""",
    "read_plan__o26": f"""with recursive packs as (select doc_id * 6 - 3 doc_id, count(*) k, count(*) filter (where too_big) big from ({page_packing(40)}) group by 1),
f as (
  select page_id doc_id, strlen(html) > 2000 as big_file, ['text/html', 'image/png', 'application/pdf', 'application/pdf', 'image/gif', 'application/zip'][page_id % 6 + 1] mime,
    page_id % 5 < 3 and len({trim('html')}) >= 16 and len(regexp_extract_all({trim('html')}, '[\\x00-\\x08\\x0B-\\x1F\\x{{FFFD}}]')) <= 0.15 * len({trim('html')}) good from pages),
n as (select l_suppkey * 2 doc_id, count(*) n from lineitem group by 1),
j as (select f.*, coalesce(n, 0) n, k, big, mime = 'application/pdf' and not good and n is null as paged from f left join n using (doc_id) left join packs using (doc_id))
select doc_id, case when mime = 'text/html' or (mime = 'application/pdf' and good) then 'text-layer' else '' end local_source,
  case when mime = 'text/html' then 'none' when mime like 'image/%' then 'image' when mime = 'application/zip' then 'unreadable'
    when n > 0 then 'images' when good then 'none' else 'pages' end track,
  (case when mime like 'image/%' then 1 when paged then case when big_file then coalesce(k, 1) else 1 end when mime = 'application/pdf' then n else 0 end)::bigint sections,
  (case when mime like 'image/%' and big_file then 1 when paged and big_file then coalesce(big, 1) else 0 end)::bigint too_big from j""",
    "pack_pages__o27": page_packing(200),
    "pack_long_files__o27": page_packing(45),
    "distinct_images__o29": f'with {IMAGES} select doc_id, "object", page, place from image',
    "image_labels__o30": f"""with {IMAGES},
n as (select *, row_number() over (partition by doc_id, page order by place, "object") k, count(*) over (partition by doc_id, page) n from image)
select doc_id, "object", 'image ' || (case when n > 1 then k || ' of ' || n || ' ' else '' end) || 'on page ' || page label from n""",
    "section_outcomes__o31": f"""with a as (
  select user_id doc_id, {K} % 20 idx, ts, event_id, case event_type when 'click' then 'read' when 'purchase' then 'read' when 'view' then 'timeout' when 'error' then 'error' else 'outage' end o
  from events),
n as (select *, count(*) filter (where o = 'timeout') over (partition by doc_id, idx order by ts, event_id rows unbounded preceding) late from a),
g as (select doc_id, idx, arg_max(o, (ts, event_id)) last, count(*) filter (where o = 'timeout') slow,
    arg_min({{'o': o, 'late': late}}, (ts, event_id)) filter (where o in ('read', 'error') and late < 2 or o = 'timeout' and late = 2) fin from n group by 1, 2)
select doc_id, idx, case when fin.o = 'timeout' then 'too_slow' when fin is not null then fin.o when last = 'outage' then 'interrupted' else 'waiting' end outcome,
  (case when fin.o = 'timeout' then 2 when fin is not null then fin.late + 1 else slow end)::bigint attempts,
  case when fin is null and last = 'outage' then 'outage' else '' end cause from g""",
    "read_progress__o32": f"""with {LINES},
b as (select doc_id, min(page - 1) stop, arg_min(l_linestatus, page) st from line where l_returnflag = 'R' and l_quantity = 1 group by 1),
n as (select l_suppkey doc_id, count(*) n from lineitem group by 1),
j as (select s_suppkey doc_id, coalesce(n, 0) total, s_acctbal > 5000 has_text, stop, st from supplier left join n on n.doc_id = s_suppkey left join b on b.doc_id = s_suppkey)
select doc_id, coalesce(stop, total)::bigint done, total::bigint total,
  case when stop is null then 'complete' when has_text then 'ready' else 'failed' end state,
  case when stop is not null and not has_text then 'The read was interrupted after section ' || stop || ' of ' || total || ' (' ||
    (case when st = 'O' then 'no AI engine was available' else 'the read was cancelled' end) || '). Retry to continue from where it stopped.' else '' end reason from j""",
    "remaining_work__o33": f"""with {LINES}, t as (select *, count(*) over (partition by doc_id) total from line)
select doc_id, page - 1 idx, total from t where doc_id % 5 = 0 or l_returnflag = 'R'""",
    "assemble_sections__o34": f"""with {SECTIONS},
parts as (select doc_id, idx // 256 part, string_agg(piece, chr(10) || chr(10) order by idx) t from s group by 1, 2),
e as (select *, min(part) filter (where {trim('t')} <> '') over (partition by doc_id) lo, max(part) filter (where {trim('t')} <> '') over (partition by doc_id) hi from parts),
k as (select doc_id, part, case when part = lo and part = hi then {trim('t')} when part = lo then ltrim(t, {q(WS)}) when part = hi then rtrim(t, {q(WS)}) else t end t from e where part between lo and hi)
select doc_id, part, strlen(t)::bigint bytes, md5(t) digest from k""",
    "section_summary__o34": f"""with {SECTIONS}
select doc_id, bool_or(read and p_size <= 45) any_text, coalesce(arg_min(p_brand, idx) filter (where read and p_size <= 45), '') model,
  (case when bool_or(read and p_size <= 45) then 'engine' else '' end) engine from s group by 1""",
    "merge_tracks__o35": f"""with j as (
  select coalesce(d.doc_id, l.doc_id) doc_id, case when lang = 'de' then '' else coalesce(d.text, '') || chr(10) || chr(10) end mine,
    coalesce(case when quality = 1 then 'Image on page 1:' || chr(10) || l.doc_id when toxic = 1 then ' ' when toxic = 0 then '[gap]' end, '') theirs, coalesce(quality = 1, false) got
  from documents d full join labels l using (doc_id))
select doc_id, md5(case when mine = '' then theirs else {trim("rtrim(mine, chr(10)) || (case when " + trim("theirs") + " = '' then '' else chr(10) || chr(10) || theirs end)")} end) text,
  case when mine = '' then 'ai' when got then 'mixed' else 'text-layer' end source, case when got then 'm' else '' end model,
  case when got then 'e' else '' end engine, mine <> '' or got any_text from j""",
    "split_paragraphs__o36a": f"""select doc_id, unnest(range(len(ps))) idx, md5(unnest(ps)) digest from (select doc_id, {paragraphs('text')} ps from documents)""",
    "query_terms__o36b": f"""select 'b' "of", item_id id, array_to_string(list_sort({terms('text')}), ',') terms from benchmark
union all select 'c', conv_id * 1000 + turn, array_to_string(list_sort({terms('text')}), ',') from conversations where role = 'user'""",
    "paragraph_scores__o36c": f"with {SCORED} select question_id, doc_id, idx, score::bigint score from scored where score > 0",
    "indexed_scores__o36c": f"with {SCORED} select question_id, doc_id, idx, score::bigint score from scored where score > 0",
    "rank_paragraphs__o36d": f"with {SCORED} select question_id, doc_id, idx, place from ranked",
    "select_paragraphs__o36e": f"with recursive {SCORED}, {pick_walk('ranked', 'question_id, doc_id', 600)} select question_id, doc_id, used, array_to_string(chosen, ',') chosen from picked",
    "leading_text__o37": f"""with recursive para as (
  select doc_id, unnest(ps) para, unnest(range(len(ps))) idx from (select doc_id, {paragraphs('text')} ps from documents)),
plain as (select doc_id, idx, idx + 1 place, strlen(para) bytes from para),
{pick_walk('plain', 'doc_id', 600)},
kept as (select k.doc_id, string_agg(p.para, chr(10) || chr(10) order by p.idx) t from picked k join para p on p.doc_id = k.doc_id and list_contains(k.chosen, p.idx) group by 1)
select d.doc_id, coalesce(used, 0)::bigint used, md5(coalesce(t, '')) digest from documents d left join picked using (doc_id) left join kept using (doc_id)""",
    "pack_pool__o38": SHARED + " select question_id, pool_id, doc_id, idx::bigint idx, decision, sent, array_to_string(chosen, ',') chosen from packed",
    "gap_rows__o39": SHARED + " select question_id, pool_id, path, gap from gap",
    "disclosure_notes__o40": NO_QUESTION + f""",
piece as (select pool_id, gap, seq // 100 piece, string_agg(path, ', ' order by seq, sub) names, {GAP_ORDER} o from gap group by pool_id, gap, piece)
select pool_id, gap, piece,
  (case when row_number() over (partition by pool_id order by o, piece) = 1 then {q(gr.NOTE_OPENING)} else '' end) ||
  (case when row_number() over (partition by pool_id, gap order by piece) = 1 then {GAP_TEXT} else '' end) || names ||
  (case when row_number() over (partition by pool_id, gap order by piece desc) = 1 then '. ' else ', ' end) ||
  (case when row_number() over (partition by pool_id order by o desc, piece desc) = 1 then {q(gr.NOTE_CLOSING)} else '' end) fragment
from piece""",
    "note_pieces__o40": SHARED + """,
shared as (select pool_id, gap, seq // 100 piece, seq, sub, path from gap where question_id is null),
own as (select question_id, pool_id, gap, seq // 100 piece, seq, sub, path from gap where question_id is not null),
touched as (select distinct question_id, pool_id, piece from own),
every as (
  select * from own union all select question_id, s.* from shared s join touched using (pool_id, piece) union all select null, * from shared)
select question_id, pool_id, gap, piece, string_agg(path, ', ' order by seq, sub) names from every group by 1, 2, 3, 4""",
    "context_counts__o41": SHARED + """ select question_id, count(*) filter (where media_type not like 'image/%') docs,
  count(*) filter (where media_type like 'image/%') images, sum(sent)::bigint bytes
from decided where decision in ('whole', 'partial', 'ref') group by 1""",
    "context_content__o38": SHARED + f""",
sent as (select * from decided where decision in ('whole', 'partial')), {CONTENT}
select question_id, (seq * 1000 + sub)::bigint ord, path, media_type, strlen(c)::bigint bytes, md5(c) digest from content""",
    "text_only__o42": SHARED + f""",
sent as (select * from decided where decision in ('whole', 'partial')), {CONTENT}
select question_id, (seq * 1000 + sub)::bigint ord, path, media_type, md5(c) digest from content where media_type not like 'image/%'
union all select distinct question_id, -2::bigint, 'grounding-note', 'text/markdown', md5({q(gr.NO_VISION_NOTE)}) from sent""",
    "pack_with_refs__o43a": REFS_NO_QUESTION + " select pool_id, doc_id, idx::bigint idx, decision, sent, coalesce(ref, '') \"ref\" from packed",
    "uses_refs__o43a": REFS + " select question_id, coalesce(bool_or(decision = 'ref'), false) retry_due from question left join (select question_id, decision from decided) using (question_id) group by 1",
    "remember_refs__o43b": SHARED + """,
sent as (
  select *, (seq * 1000 + sub)::bigint ord, case when part = 'image' then path else 'title ' || (doc_id % 40) end p from decided where decision in ('whole', 'partial')),
origin as (select question_id, p, arg_max({'doc_id': doc_id, 'part': part, 'idx': idx}, ord) u from sent where decision = 'whole' group by 1, 2),
back as (select question_id, p, ord, 'g-' || question_id || '-' || ord r from sent where doc_id % 4 <> 3)
select u.doc_id doc_id, u.part part, u.idx::bigint idx, arg_max(r, (question_id, ord)) "ref" from back join origin using (question_id, p) group by 1, 2, 3""",
    "invalidate_refs__o43c": f"""select doc_id, case when toxic = 0 then 'text' else 'image' end part, 'ref-' || doc_id "ref" from labels
where (quality = 1 or toxic = 1) and doc_id not in {GONE}""",
    "display_paths__o44": """select doc_id, case when doc_id % 9 = 0 then 'document' else source end path,
  (case when doc_id % 9 = 0 then 'document' else source end) || (case when doc_id % 4 > 0 then ' (image on page ' || (doc_id % 4) || ').jpg' else ' (image).jpg' end) image from documents""",
    "fold_graphs__o45": GRAPHS,
    "parse_answers__o46": f"""with {PART_JSON} select graph_id, c in (0, 1, 2, 5) usable, case c when 0 then 'all' when 5 then 'nothing found' else '' end note,
  (case when c in (0, 1) then 2 else 0 end)::bigint nodes, (case when c in (0, 2) then 1 else 0 end)::bigint edges from ans""",
    "answer_elements__o46": f"""with {PART_JSON}
select graph_id, 'node' what, '0|n' || graph_id || '|' || p_name || '|P' as "value", p_retailprice x from ans where c in (0, 1)
union all select graph_id, 'node', '1|hub|Hub|H', 1.5 from ans where c in (0, 1)
union all select graph_id, 'port', unnest(['0|0|a|In', '0|1|b|Out', '1|0|c|Hub in']), 0.0 from ans where c in (0, 1)
union all select graph_id, 'edge', '0|n' || graph_id || '|b|hub|c|' || p_brand, 0.0 from ans where c in (0, 2)""",
    "sanitise_nodes__o47a": f'with {NODES} select graph_id, id, ord, "name", left(symbol, 16) symbol, x, y from node',
    "sanitise_ports__o47b": f"""with {NODES} select graph_id, node, id, ord::bigint ord, 'Port ' || id "name" from port""",
    "sanitise_edges__o47c": f"""with {NODES}, {EDGES}
select graph_id, ord, from_node, from_port, to_node, to_port, label from edge e where ord <= 600
  and exists (from port p where p.graph_id = e.graph_id and p.node = e.from_node and p.id = e.from_port)
  and exists (from port p where p.graph_id = e.graph_id and p.node = e.to_node and p.id = e.to_port)""",
    "edge_ids__o47d": f"""with {NODES}, {EDGES},
r as (select *, row_number() over (partition by graph_id, id order by ord) n from edge_id)
select graph_id, ord, case when id <> '' and n = 1 then id else left(sha256(graph_id || ':' || ord), 16) end id from r""",
    "source_keys__o48b": f"""with {POOL}, e as (select pool_id, doc_id || ':' || created entry from pool)
select pool_id, left(string_agg(entry, '|' order by entry), 128) source_key, bit_xor(('0x' || substr(md5(entry), 1, 15))::bigint) digest, count(*) n from e group by 1""",
    "stale_graphs__o48b": f"with {POOL} select pool_id, bool_or(state = 'ready') stale from pool group by 1 having bool_or(state <> 'ready')",
    "delete_nodes__o48c": f"""with {NODES}, {EDGES}
select graph_id, ord, from_node, to_node from edge e where not exists (from node0 n where n.graph_id = e.graph_id and n.y > 0 and n.id in (e.from_node, e.to_node))""",
    "distinct_cables__o48d": f"""with {NODES}, {EDGES},
r as (select *, row_number() over (partition by graph_id, from_node, to_node order by ord) n from edge)
select graph_id, ord, case when ord % 2 = 1 then from_node else to_node end from_node, case when ord % 2 = 1 then to_node else from_node end to_node from r where n = 1""",
    "generation_outcomes__o48e": f"""with a as (select *, {K} k from events),
j as (select *, k % 8 n from a)
select event_id attempt_id, user_id graph_id, case when event_type in ('click', 'view', 'purchase') and n > 0 then 'ok' when event_type = 'error' then 'failed' else 'empty' end state,
  n::bigint nodes, repeat('n', least(k * 40, 2000)) note, repeat('m', least(k * 2, 100)) model, '' engine, repeat('k', least(k * 3, 128)) source_key from j""",
    "sanitise_transcript__o49a": f'with {TALK} select "owner", turn, role, {clip("t", 200)} text, model, engine, created from talk',
    "render_prompts__o49b": f"""with {TALK},
r as (select "owner", string_agg((case when role = 'user' then 'User: ' else 'Assistant: ' end) || t, chr(10) || chr(10) order by turn) t from talk group by 1)
select "owner", md5('You help.' || chr(10) || chr(10) || (case when coalesce(quality, 0) = 0 then 'The room is empty.' || chr(10) || chr(10) else '' end) || t || chr(10) || chr(10) || 'Assistant:') digest
from r left join labels on doc_id = "owner" """,
    "latest_jobs__o50": f"""with l as (
  select user_id job_id, arg_max(event_type, (ts, event_id)) e, arg_max({SECONDS}, (ts, event_id)) sec from events group by 1)
select job_id, case e when 'error' then 'failed' when 'purchase' then 'done' else 'running' end state, (case when e in ('error', 'purchase') then sec else 0 end)::bigint done
from l where e not in ('error', 'purchase') or sec >= {JOBS_NOW} - 259200""",
    "judge_uploads__o51": f"""with {judged('batch', 20)}
select batch, ord, "name", case when reason = '' then mime else '' end mime, size::bigint size, reason = '' accepted, reason from judged""",
    "batch_outcomes__o51": f"""with {judged('ord // 3', 2)},
g as (
  select batch, count(*) filter (where reason = '') ok, count(*) filter (where reason <> '') bad,
    arg_min("name" || ': ' || reason, ord) filter (where reason <> '') f from judged group by 1)
select batch, ok accepted, bad rejected, case when ok > 0 then 'ok' else 'rejected' end outcome, case when ok > 0 then '' else f end detail from g
union all select -1 - batch, 0, 0, 'nothing', 'No files were uploaded' from g""",
    "newest_first__o52": f"with {POOL} select doc_id, created, title from pool order by created desc, doc_id desc limit 100",
    "read_sections__o53": f"""with {UPLOAD},
s as (select ord, len(hx) // 2 size, ord % 11 = 0 noted from up)
select ord doc_id, case when noted or size > 9000 or size % 7 = 0 then '' else 'f' || ord || (case when ord % 3 = 0 then ' (page 1)' else '' end) || '.pdf:' || size end text,
  case when noted then 'a note' else '' end note, size > 9000 and not noted too_big,
  case when noted then '' when size > 9000 then 'too large to read in one request' when size % 7 = 0 then 'unreadable' else '' end err,
  case when noted or size > 9000 or size % 7 = 0 then '' else 'model' end model from s""",
    "answer_questions__o54": SHARED + f""",
n as (select question_id, count(*) n, count(*) filter (where media_type like 'image/%') pics, sum(sent) size,
    coalesce(sum(sent) filter (where media_type not like 'image/%'), 0) + strlen({q(gr.NO_VISION_NOTE)}) seen from decided where decision in ('whole', 'partial') group by 1),
b as (select item_id question_id, len({trim('text')}) len, coalesce(n, 0) n, coalesce(pics, 0) pics, coalesce(size, 0)::bigint size, seen::bigint seen from benchmark left join n on n.question_id = item_id),
r as (select *, pics > 0 and len % 2 = 1 blind from b)
select question_id, case when len % 5 = 0 then '' else len || ':' || (case when blind then (n - pics + 1) || ':' || seen else n || ':' || size end) end "output",
  case when len % 5 = 0 then 'unavailable' else '' end error, (case when len % 5 = 0 or n = 0 then 0 else 1 end)::bigint refs from r""",
    "read_files__o33": f"""with {LINES},
plan as (
  select s_suppkey doc_id, coalesce(n, 0) total, s_acctbal > 5000 has_text, s_nationkey % 2 = 0 has_ai
  from supplier left join (select l_suppkey s_suppkey, count(*) n from lineitem group by 1) using (s_suppkey)),
s as (
  select doc_id, page - 1 idx, total, has_text, has_ai, l_quantity qty, p_name, page, l_linestatus = 'O' pic,
    case when p_size = 1 then 'note' when p_size = 2 then 'too_big' when not has_ai then 'error'
      when l_returnflag = 'R' and l_quantity <= 10 then 'too_slow' when l_returnflag = 'A' and l_quantity > 45 then 'unreadable' else 'read' end o,
    has_ai and p_size > 2 and l_returnflag = 'R' and l_quantity <= 2 as out
  from line join part on p_partkey = l_partkey join plan using (doc_id) where has_ai or has_text or p_size <= 2),
piece as (
  select doc_id, idx, case o when 'note' then '[not decoded]' when 'too_big' then '[page ' || page || ': too large to read in one request — this part was not read]'
    when 'error' then '[page ' || page || ': could not be read: no recogniser is configured]' when 'unreadable' then '[page ' || page || ': could not be read: unreadable]'
    when 'too_slow' then '[page ' || page || ': could not be read: {ex.TOO_SLOW}]' else (case when pic then 'Image on page ' || page || ':' || chr(10) else '' end) || p_name end t from s),
body as (select doc_id, {trim("string_agg(t, chr(10) || chr(10) order by idx)")} t from piece group by 1),
n as (
  select doc_id, min(idx) filter (where out) stop, count(*) filter (where not out) read1, count(*) filter (where out) read2, bool_or(o = 'read') legible from s group by 1),
f as (
  select *, case when not has_ai and not has_text then 'failed' else 'ready' end state,
    (case when has_text then 'file ' || doc_id || chr(10) || chr(10) else '' end) || coalesce(t, '') whole from plan left join n using (doc_id) left join body using (doc_id))
select doc_id, case when state = 'failed' then 'failed' when stop is null or has_text then 'ready' else 'failed' end state1, case when state = 'failed' then 0 else coalesce(stop, 0) end::bigint done1,
  case when state = 'failed' then {q(ex.READ_FAILURES['no_ai'])} when stop is null or has_text then '' else
    'The read was interrupted after section ' || stop || ' of ' || total || ' ({ex.INTERRUPTIONS['outage']}). Retry to continue from where it stopped.' end reason1,
  state, 0::bigint done, 0::bigint total, read1, read2,
  case when state = 'failed' then null when not has_text then 'ai' when legible then 'mixed' else 'text-layer' end source,
  case when state = 'failed' then null else strlen({trim('whole')}) end::bigint bytes from f""",
    "ask_turns__o54": TURNS + """
select turn, question_id, case when error = '' then said else '' end "output", error,
  (case when error <> '' then 0 when blind then n - pics else n end)::bigint refs from new""",
    "ref_ledger__o43b": TURNS + f"""
select doc_id, part, idx::bigint idx, ref from ledger2 union {UNITS.format('last', "error = ''").replace('u.idx,', 'u.idx::bigint,')}""",
    "author_text__o55": f"""select doc_id post_id, case when doc_id % 7 = 0 then '' else 'doc ' || doc_id end title, 'text' kind, 'text/markdown' mime, lang description,
  md5(case when doc_id % 11 = 0 then '' else {trim('text')} end) "content", (case when doc_id % 11 = 0 then 0 else strlen({trim('text')}) end)::bigint size, source author, {NOW}::bigint created,
  case when doc_id % 7 = 0 then 'A title is required' when doc_id % 11 = 0 or {trim('text')} = '' then 'The document must not be empty' else '' end reason from documents""",
    "final_state__o56": f"""with r as (
  select l_orderkey doc_id, l_linenumber - 1 idx, case when l_quantity > 48 then 'too_big' when l_quantity = 1 then 'interrupted' when l_returnflag = 'R' then 'too_slow' when l_returnflag = 'A' then 'note' else 'read' end o from lineitem),
fin as (select distinct doc_id, idx from r where o <> 'interrupted'),
prefix as (select doc_id, count(*) done from (select doc_id, idx, row_number() over (partition by doc_id order by idx) - 1 k from fin) where idx = k group by 1),
g as (select doc_id, count(*) n, count(distinct idx) places, bool_or(o = 'read') legible, bool_or(o = 'too_big') big, bool_or(o = 'too_slow') slow, bool_or(o <> 'note') ai from r group by 1),
j as (
  select o_orderkey doc_id, o_orderstatus = 'F' has_text, o_orderpriority <> '1-URGENT' has_ai, coalesce(n, 0) n, coalesce(places, 0) + (case when n > 3 and o_orderpriority = '5-LOW' then 1 else 0 end) total,
    coalesce(done, 0) done, coalesce(legible, false) legible, coalesce(big, false) big, coalesce(slow, false) slow, coalesce(ai, false) ai
  from orders left join g on g.doc_id = o_orderkey left join prefix on prefix.doc_id = o_orderkey),
h as (select j.*, exists (from r where r.doc_id = j.doc_id and r.idx = j.done and o = 'interrupted') broken from j),
c as (
  select *, case when total = 0 then (case when has_text then 'local' else 'nothing' end)
    when not has_text and not has_ai and (ai or n < total) then 'no_ai' when not has_text and total = 1 and big then 'too_large'
    when done < total then (case when has_text then 'usable' when broken then 'stopped' else 'reading' end)
    when has_text or legible then 'done' when big then 'too_big' when slow then 'too_slow' else 'nothing_read' end c from h)
select doc_id, case when c in ('local', 'done', 'usable') then 'ready' when c = 'reading' then 'reading' else 'failed' end state,
  case c when 'no_ai' then {q(ex.READ_FAILURES['no_ai'])} when 'too_large' then {q(ex.READ_FAILURES['too_large'])} when 'too_big' then {q(ex.NO_TEXT['too_big'])}
    when 'too_slow' then {q(ex.NO_TEXT['too_slow'])} when 'nothing' then {q(ex.NO_TEXT['nothing'])} when 'nothing_read' then {q(ex.NO_TEXT['nothing'])}
    when 'stopped' then 'The read was interrupted after section ' || done || ' of ' || total || ' (no AI engine was available). Retry to continue from where it stopped.' else '' end reason,
  (case when c in ('usable', 'stopped', 'reading') then done when c in ('nothing_read', 'too_big', 'too_slow') then total else 0 end)::bigint done,
  (case when c in ('usable', 'stopped', 'reading', 'nothing_read', 'too_big', 'too_slow') then total else 0 end)::bigint total,
  c not in ('nothing_read', 'too_big', 'too_slow') keep_images, c in ('nothing', 'no_ai', 'too_large', 'usable', 'stopped', 'reading') keep_results from c""",
    "stream_extract_state__s1": f"with {STATE} select * from folded where doc_id in (select doc_id from documents)",
    "stream_graph_state__s2": GRAPHS,
    "failure_sentences__o23": f"""with e as (
  select event_id, {K} k, ['no_ai', 'too_large', 'unavailable', 'no_bytes', 'disabled', 'outage', 'timeout', 'other'][{K} % 8 + 1] c from events)
select event_id,
  case c when 'no_ai' then {q(ex.READ_FAILURES['no_ai'])} when 'too_large' then {q(ex.READ_FAILURES['too_large'])} when 'unavailable' then {q(ex.READ_FAILURES['unavailable'])}
    when 'no_bytes' then {q(ex.READ_FAILURES['no_bytes'])} else {q(ex.READ_FAILURE)} end "read",
  case c when 'disabled' then {q(ex.ASK_FAILURES['disabled'])} when 'unavailable' then {q(ex.ASK_FAILURES['unavailable'])} else {q(ex.ASK_FAILURE)} end asked,
  'The read was interrupted after section ' || (k % 5) || ' of 5 (' || (case c when 'outage' then 'no AI engine was available' when 'timeout' then 'a section took too long'
    else 'the read was cancelled' end) || '). Retry to continue from where it stopped.' stopped from e""",
    "stream_section_progress__s3": f"""with recursive ev as (
  select user_id doc_id, {K} % 20 idx, epoch_ms(ts) t, row_number() over (partition by user_id, {K} % 20 order by ts, event_id) n,
    case event_type when 'view' then 'start' when 'signup' then 'outage' when 'error' then 'error' else 'read' end kind from events),
walk(doc_id, idx, n, late, deadline, ended, outcome, attempts) as (
  select distinct doc_id, idx, 0::bigint, 0, 0::bigint, false, null::varchar, 0 from ev
  union all
  select w.doc_id, w.idx, w.en,
    case when w.ended or not due then w.late else w.late + 1 end,
    case when w.ended or kind <> 'start' or (due and w.late = 1) then 0 else t + 300000 * (w.late + due::int + 1) end,
    w.ended or kind in ('read', 'error') or (due and w.late = 1),
    case when w.ended then w.outcome when due and w.late = 1 then 'too_slow' when kind = 'outage' then 'interrupted' when kind <> 'start' then kind when due then 'timeout' else w.outcome end,
    case when w.ended then w.attempts when due and w.late = 1 then 2 when kind = 'outage' then w.late + due::int when kind <> 'start' then w.late + due::int + 1 when due then w.late + 1 else w.attempts end
  from (select w.*, e.n en, e.t, e.kind, (w.deadline > 0 and e.t >= w.deadline) due from walk w join ev e on e.doc_id = w.doc_id and e.idx = w.idx and e.n = w.n + 1) w),
last as (select *, row_number() over (partition by doc_id, idx order by n desc) r from walk),
fired as (select *, not ended and deadline > 0 and deadline <= (select max(t) from ev) - 60000 due from last where r = 1)
select doc_id, idx::int idx, case when due then (case when late = 1 then 'too_slow' else 'timeout' end) else outcome end outcome,
  (case when due then late + 1 else attempts end)::int attempts from fired where due or outcome is not null""",
    "stream_stored_files__s5": f"""with {STORED}
select batch, (len(hx) // 2)::bigint size, mime,
  case when mime = '' then 'files of type application/octet-stream can''t be read as room knowledge — upload an image, PDF, or text document' else '' end reason
from (select *, ['text/plain; charset=utf-8', 'image/png', 'application/pdf', 'image/jpeg', 'image/gif', ''][batch % 6 + 1] mime from stored)""",
    "stream_new_files__s5": """select url path, "name", case when lower("name") like '%.md' or lower("name") like '%.markdown' then 'text/markdown'
  when lower("name") like '%.csv' then 'text/csv' else 'text/plain; charset=utf-8' end mime, size
from (select url, arg_max(strlen(html), page_id)::bigint size, case when regexp_extract(url, '([^/]*)$', 1) = '' then 'file' else regexp_extract(url, '([^/]*)$', 1) end "name" from pages group by url)""",
}
