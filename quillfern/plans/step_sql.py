"""DuckDB oracles of the queries that go step by step: recursive tables and list expressions in place of loops."""

from __future__ import annotations

from quillfern.operators.grouped import bandpass_sections
from quillfern.plans.q_series import ACTIVITY_SQL, E_SQL, FRAME_SQL, N_SQL

PLAIN = r"""trim(lower(regexp_replace(text, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')))"""


def recursive(sql: str) -> str:
    return sql.strip().replace("with ", "with recursive ", 1)


VALLEYS = N_SQL + """,
p as (select user_id, event_id, i, -value as x from n),
f as (select *, case when x is distinct from lag(x) over (partition by user_id order by i) then 1 else 0 end as f from p),
r as (select *, sum(f) over (partition by user_id order by i rows unbounded preceding) as run from f),
g as (select user_id, run, any_value(x) as x, min(i) as a, max(i) as b from r group by 1, 2),
t as (select user_id, x, (a + b) // 2 as i from (select *, lag(x) over w as px, lead(x) over w as nx from g window w as (partition by user_id order by run)) where px < x and nx < x),
b as (select t.user_id, t.i, t.x, coalesce(max(p.i) filter (where p.i < t.i and p.x > t.x), 0) as lo, coalesce(min(p.i) filter (where p.i > t.i and p.x > t.x), 1000000000) as hi
  from t join p on p.user_id = t.user_id group by 1, 2, 3),
m as (select b.user_id, b.i, b.x - greatest(min(p.x) filter (where p.i <= b.i), min(p.x) filter (where p.i >= b.i)) as d from b join p on p.user_id = b.user_id and p.i > b.lo and p.i < b.hi group by b.user_id, b.i, b.x)
select m.user_id, n.event_id, round(d, 6) as prominence from m join n on n.user_id = m.user_id and n.i = m.i where d >= 5.0"""

ONSETS = recursive(N_SQL + """,
z as (select *, case when max(value) over u > min(value) over u then (value - min(value) over u) / (max(value) over u - min(value) over u) else 0 end as z from n window u as (partition by user_id)),
c as (select *, z = max(z) over (partition by user_id order by i rows between 3 preceding and current row)
  and z >= avg(z) over (partition by user_id order by i rows between 10 preceding and 10 following) + 0.07 as ok from z),
k as (select user_id, event_id, i, row_number() over (partition by user_id order by i) as q from c where ok),
o as (select user_id, event_id, q, i, i as last, true as taken from k where q = 1
  union all select k.user_id, k.event_id, k.q, k.i, case when k.i - o.last > 3 then k.i else o.last end, k.i - o.last > 3 from o join k on k.user_id = o.user_id and k.q = o.q + 1),
l as (select user_id, i, event_id as low from (select *, lag(value) over w as p, lead(value) over w as q from n window w as (partition by user_id order by i)) where i = 1 or (value <= p and value < q))
select o.user_id, o.event_id, l.low as from_event from (select * from o where taken) o asof join l on o.user_id = l.user_id and o.i >= l.i""")

SPLIT = recursive(FRAME_SQL.rstrip() + """,
x as (select user_id, frame, n > 1 as flux, coalesce(peak, 0) as level, n = 0 as valley,
  max(case when n > 0 then 1 else 0 end) over (partition by user_id order by frame rows between 6 preceding and 6 following) = 1 as wide,
  coalesce(max(case when n > 1 then frame end) over (partition by user_id order by frame rows unbounded preceding), 0) as l,
  coalesce(min(case when n > 1 then frame end) over (partition by user_id order by frame rows between current row and unbounded following), max(frame) over (partition by user_id)) as r from f),
c as (select v.user_id, v.frame as v, q.frame as idx, q.r - q.l as w from (select * from x where valley) v join (select * from x where not flux) q
  on q.user_id = v.user_id and q.frame >= v.frame - 3 and q.frame < v.frame + 3 qualify row_number() over (partition by v.user_id, v.frame order by q.level, q.frame) = 1),
i as (select user_id, min(frame) as a, max(frame) + 1 as b from (select *, frame - row_number() over (partition by user_id order by frame) as g from x where wide) group by user_id, g),
b as (select user_id, a, b, cast(null as bigint) as cut from i
  union all select user_id, unnest([a, idx + 1]), unnest([idx, b]), idx from (
    select b.user_id, b.a, b.b, c.idx, row_number() over (partition by b.user_id, b.a, b.b order by c.w desc, c.v) as k from b join c on c.user_id = b.user_id and c.v between b.a + 6 and b.b - 7 and c.w >= 4
    where b.b - b.a > 48) where k = 1)
select user_id, frame, wide and (user_id, frame) not in (select (user_id, cut) from b where cut is not null) as active from x""")


def bandpass_sql(low: float, high: float, rate: float) -> str:
    """All sections in one recursion: signal k of a row is the output of section k, with the two values before it."""
    sections = bandpass_sections(low, high, rate)
    k = len(sections)
    signals = ["cast(value as double) as s0"]
    first = ["cast(value as double) as s0"]
    for j, (g, a1, a2) in enumerate(sections, 1):
        first.append(f"{g!r} * s{j - 1} as s{j}")
        signals.append(f"{g!r} * (s{j - 1} - p{j - 1}) - ({a1!r}) * o{j} - ({a2!r}) * p{j} as s{j}")
    names = ", ".join(f"s{j}" for j in range(k + 1))
    zero = ", ".join(f"cast(0 as double) as z{j}" for j in range(k + 1))
    return recursive(N_SQL + f""",
y as (select user_id, event_id, i, {names}, {zero} from (select user_id, event_id, i, {", ".join(first)} from n where i = 1)
  union all select user_id, event_id, i, {names}, {", ".join(f"o{j}" for j in range(k + 1))} from (
    select *, {", ".join(signals)} from (
      select n.user_id, n.event_id, n.i, n.value, {", ".join(f"y.s{j} as o{j}, y.z{j} as p{j}" for j in range(k + 1))} from y join n on n.user_id = y.user_id and n.i = y.i + 1)))
select user_id, event_id, round(s{k}, 6) as y from y""")


SPECTRUM = """with x as (select vec_id, unnest(range(0, len(embedding))) as k, unnest(embedding)::double as v from embeddings),
y as (select vec_id, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 64)) as v from x),
f as (select vec_id, b, pow(sum(v * cos(2 * pi() * k * b / 64)), 2) + pow(sum(v * sin(2 * pi() * k * b / 64)), 2) as p from y, range(33) t(b) group by 1, 2),
d as (select *, greatest(-80.0, 10 * log10(greatest(p, 1e-10) / greatest(max(p) over (partition by vec_id), 1e-10))) as db from f)
select vec_id, cast(min(b) filter (where db = 0) as integer) as peak_bin, round(avg(db), 6) as mean_db from d group by vec_id"""


#: Matching blocks of lists a and b, after difflib's rule: the longest common run, the earliest of equals, then the same on both sides of it. Wants p(key, a, b).
MATCHES = """
cells as (select x.key, i, j from (select key, unnest(range(1, len(a) + 1)) as i, unnest(a) as v from p) x join (select key, unnest(range(1, len(b) + 1)) as j, unnest(b) as v from p) y on y.key = x.key and y.v = x.v),
runs as (select key, min(i) as i, min(j) as j, count(*) as n from (select *, i - row_number() over (partition by key, i - j order by i) as g from cells) group by key, i - j, g),
w as (select key, cast(1 as bigint) as a0, cast(len(a) + 1 as bigint) as a1, cast(1 as bigint) as b0, cast(len(b) + 1 as bigint) as b1, cast(null as bigint) as i, cast(null as bigint) as j, cast(null as bigint) as n from p
  union all select key, unnest([a0, i + n]), unnest([i, a1]), unnest([b0, j + n]), unnest([j, b1]), i, j, n from (
    select *, row_number() over (partition by key, a0, a1, b0, b1 order by n desc, i, j) as place from (
      select w.key, a0, a1, b0, b1, runs.i + shift as i, runs.j + shift as j, least(runs.n, a1 - runs.i, b1 - runs.j) - shift as n
      from w join runs on runs.key = w.key, lateral (select greatest(a0 - runs.i, b0 - runs.j, 0) as shift)) where n > 0) where place = 1),
blocks as (select distinct key, i, j, n from w where n is not null)"""

#: Adjacent turns of a conversation as words: t(conv_id, turn, ref, hyp).
TURNS = f"""with tw as (select conv_id, turn, list_filter(regexp_split_to_array({PLAIN}, '\\s+'), lambda x: x <> '') as hyp from conversations),
t as (select * from (select *, lag(hyp) over (partition by conv_id order by turn) as ref from tw) where ref is not null)"""

DIFF = recursive(TURNS + f""",
p as (select {{'c': conv_id, 't': turn}} as key, ref as a, hyp as b from t),{MATCHES},
e as (select key, i, j, n from blocks union all select key, len(a) + 1, len(b) + 1, 0 from p),
g as (select *, coalesce(lag(i + n) over w, 1) as pi, coalesce(lag(j + n) over w, 1) as pj from e window w as (partition by key order by i, j)),
o as (select g.key, g.i, g.j, case when g.i - pi = g.j - pj then b[pj:g.j - 1] else a[pi:g.i - 1] end as gap, b[g.j:g.j + n - 1] as same from g join p on p.key = g.key),
x as (select key, flatten(list(list_concat(gap, same) order by i, j)) as words from o group by key)
select key.c as conv_id, key.t as turn, cast(len(words) as integer) as n, array_to_string(words, ' ') as text from x""")

RATIO = recursive(f"""with q as (select distinct p_name as x, lower(p_type) as y from part),
p as (select {{'x': x, 'y': y}} as key, list_transform(string_split(x, ''), lambda c: c) as a, string_split(y, '') as b from q),{MATCHES},
s as (select key, sum(n) as n from blocks group by key)
select p_partkey, round(2.0 * coalesce(s.n, 0) / (length(p_name) + length(p_type)), 6) as ratio, 2.0 * coalesce(s.n, 0) / (length(p_name) + length(p_type)) >= 0.6 as alike
from part left join s on s.key = {{'x': p_name, 'y': lower(p_type)}}""")


def metaphone_sql(word: str) -> str:
    """The sound code of a lower-case word, as a fold over its places. s: the word's letters after the rules for its start; the fold keeps how many places are taken already."""
    letters = f"regexp_replace({word}, '[^a-z]', '', 'g')"
    begun = f"case when {letters}[1:2] in ('kn', 'gn', 'pn', 'wr', 'ae') then {letters}[2:] else {letters} end"
    s = f"(case when ({begun})[1:2] = 'wh' then 'w' || ({begun})[3:] when ({begun})[1:1] = 'x' then 's' || ({begun})[2:] else {begun} end)"
    rules = """
      case when acc.skip > 0 then {'skip': acc.skip - 1, 'out': acc.out}
      when i > 1 and s[i] = s[i - 1] and s[i] <> 'c' then acc
      when s[i] in ('a', 'e', 'i', 'o', 'u') then {'skip': 0, 'out': acc.out || case when i = 1 then upper(s[i]) else '' end}
      when s[i] = 'b' then {'skip': 0, 'out': acc.out || case when i > 1 and s[i - 1] = 'm' and i = length(s) then '' else 'B' end}
      when s[i:i + 1] = 'ch' then {'skip': 1, 'out': acc.out || case when i > 1 and s[i - 1] = 's' then 'K' else 'X' end}
      when s[i:i + 2] = 'cia' then {'skip': 0, 'out': acc.out || 'X'}
      when s[i:i + 1] in ('ci', 'ce', 'cy') then {'skip': 0, 'out': acc.out || case when i > 1 and s[i - 1] = 's' then '' else 'S' end}
      when s[i:i + 2] in ('dge', 'dgi', 'dgy') then {'skip': 2, 'out': acc.out || 'J'}
      when s[i:i + 1] = 'gh' and s[i + 2:i + 2] not in ('a', 'e', 'i', 'o', 'u') then {'skip': 1, 'out': acc.out}
      when s[i:i + 1] = 'gn' and (i + 1 >= length(s) or s[i:] = 'gned') then {'skip': 0, 'out': acc.out}
      when s[i:i + 1] in ('gi', 'ge', 'gy') then {'skip': 0, 'out': acc.out || 'J'}
      when s[i] = 'h' then {'skip': 0, 'out': acc.out || case when s[i + 1:i + 1] in ('a', 'e', 'i', 'o', 'u') and (i = 1 or s[i - 1] not in ('c', 's', 'p', 't', 'g')) then 'H' else '' end}
      when s[i] = 'k' then {'skip': 0, 'out': acc.out || case when i > 1 and s[i - 1] = 'c' then '' else 'K' end}
      when s[i:i + 1] = 'ph' then {'skip': 1, 'out': acc.out || 'F'}
      when s[i:i + 1] = 'sh' then {'skip': 1, 'out': acc.out || 'X'}
      when s[i:i + 2] in ('sio', 'sia', 'tia', 'tio') then {'skip': 0, 'out': acc.out || 'X'}
      when s[i:i + 1] = 'th' then {'skip': 1, 'out': acc.out || '0'}
      when s[i:i + 2] = 'tch' then {'skip': 0, 'out': acc.out}
      when s[i] in ('w', 'y') then {'skip': 0, 'out': acc.out || case when s[i + 1:i + 1] in ('a', 'e', 'i', 'o', 'u') then upper(s[i]) else '' end}
      when s[i] = 'x' then {'skip': 0, 'out': acc.out || 'KS'}
      else {'skip': 0, 'out': acc.out || translate(s[i], 'cdfgjlmnpqrstvz', 'KTFKJLMNPKRSTFS')} end"""
    return f"list_reduce(range(1, length(s) + 1), lambda acc, i: {rules.strip()}, {{'skip': cast(0 as bigint), 'out': ''}}).out".replace("\n", " "), s


def coded(words: str) -> str:
    """c(word, code) of the distinct words of a table expression with a column word."""
    fold, start = metaphone_sql("word")
    return f"c as (select word, case when s = '' then '' else {fold} end as code from (select word, {start} as s from (select distinct word from {words})))"


METAPHONE = f"""with x as (select p_partkey, unnest(range(0, len(ws))) as i, unnest(ws) as word from (select p_partkey, string_split(p_name, ' ') as ws from part)),
{coded("x")}
select p_partkey, cast(i as integer) as i, word, code from x join c using (word)"""

#: Segments in units of six hours, so that neighbours may be nearer than two units.
EDGES = ACTIVITY_SQL + """,
sg as (select user_id, seg as k, start / 2.16e10 as s, stop / 2.16e10 as e, seg % 4 as kind, max(seg) over (partition by user_id) as top from act),
l as (select *, lag(s) over w as ps, lag(e) over w as pe, lead(s) over w as ns, lead(e) over w as ne, lag(kind) over w as pk from sg window w as (partition by user_id order by k)),
h as (select *, coalesce(kind in (1, 2) and abs(e - ns) < 2, false) as reach, coalesce(pk in (1, 2) and abs(pe - s) < 2, false) as reached from l),
r as (select *, coalesce(kind in (0, 2) and not reached and abs(s - pe) < 2, false) as back from h),
w as (select *, unnest(range(0, 6)) as i from r)
select user_id, cast(k as integer) as line, cast(i as integer) as word,
  round(case when kind = 3 and top = 0 then s when kind = 3 then a + i * (e - a) / 6 when i = 0 and kind in (0, 2) then least(s + (e - s) / 6, case when back then ps else s end)
    when i = 5 and kind in (1, 2) then least(s + 5 * (e - s) / 6, case when reach then ne else e end) else s + i * (e - s) / 6 end, 3) as start_s,
  round(case when kind = 3 and top = 0 then e when kind = 3 then a + (i + 1) * (e - a) / 6 when i = 0 and kind in (0, 2) then greatest(s + (e - s) / 6, case when back then ps else s end)
    when i = 5 and kind in (1, 2) then greatest(s + 5 * (e - s) / 6, case when reach then ne else e end) else s + (i + 1) * (e - s) / 6 end, 3) as end_s,
  1 + cast(back as integer) + cast(reach as integer) as n_ids
from (select *, case when k = 0 then s when reached then s else least(ps, s) end as a from w)"""


def _nearest(points: str, to: str) -> str:
    return f"list_sort(list_transform({points}, lambda x: {{'d': abs(x - ({to})), 'x': x}}))[1].x"


def _snap(s: str, e: str, limit: str) -> tuple[str, str]:
    """Expressions of the snapped end, and of the snapped start given the end as column se."""
    later = f"list_filter(onsets, lambda x: x > ({s} + {e}) / 2 and x < {limit})"
    earlier = "list_filter(onsets, lambda x: x < se - 0.04)"
    return f"coalesce({_nearest(later, e)}, {e})", f"coalesce({_nearest(earlier, s)}, {s})"


_ONE_END, _ONE_START = _snap("s", "e", "1e300")
_TWO_END, _TWO_START = _snap("s", "e", "later")
BOUNDS = recursive(ACTIVITY_SQL.replace("from events)", "from events where user_id is not null)", 1) + f""",
z as (select user_id, min(us) as zero from e group by 1),
t as (select e.user_id, event_type, (us - zero) / 1e6 as t, value, row_number() over (partition by e.user_id, event_type order by us, event_id) as k from e join z on z.user_id = e.user_id),
on_ as (select user_id, list(t order by t) as onsets from t where event_type = 'error' group by 1),
mk as (select act.user_id, list({{'a': (start - zero) / 1e6, 'b': (stop - zero) / 1e6}} order by start) as masks from act join z on z.user_id = act.user_id group by 1),
wd as (select q.user_id, q.k, q.t as q0, q.t + 1 + q.value / 100 as q1, w.t as w0, w.t + 1 + w.value / 100 as w1, m.t as m0, m.t + 1 + m.value / 100 as m1, w.value / 500 as ws, m.value / 500 as ms,
    coalesce(onsets, []) as onsets, coalesce(masks, []) as masks
  from (select * from t where event_type = 'click') q join (select * from t where event_type = 'view') w on w.user_id = q.user_id and w.k = q.k
  join (select * from t where event_type = 'purchase') m on m.user_id = q.user_id and m.k = q.k left join on_ on on_.user_id = q.user_id left join mk on mk.user_id = q.user_id),
o0 as (select *, case when ws > 0.1 and w0 > m1 then w0 when ms > 0.1 then m0 end as s, case when ws > 0.1 and w0 > m1 then w1 when ms > 0.1 then m1 end as e, case when ws > 0.1 and w0 > m1 then ws when ms > 0.1 then ms end as sc from wd),
o1 as (select *, {_ONE_END} as se from o0),
o2 as (select * exclude (s, e, se), case when s is not null then {_ONE_START} end as g0, case when s is not null then se end as g1 from o1),
o3 as (select *, coalesce(min(g0) over (partition by user_id order by k rows between 1 following and unbounded following), 1e300) as later,
  case when q1 - q0 > 0 and q1 - q0 < 4 and abs(q0 - m0) <= 1 and abs(q1 - m1) <= 1 then q0 when ms > 0.001 then m0 end as b0,
  case when q1 - q0 > 0 and q1 - q0 < 4 and abs(q0 - m0) <= 1 and abs(q1 - m1) <= 1 then q1 when ms > 0.001 then m1 end as b1 from o2),
r as (select user_id, cast(0 as bigint) as k, cast(null as double) as got, cast(0 as double) as end_, cast(null as double) as start_, cast(null as double) as score from wd group by 1
  union all select user_id, k, f1, greatest(cs, ce), cs, score from (
    select *, case when len(tm) > 0 then greatest(s, tm[1].a) when len(hit) > 0 then greatest(s, hit[len(hit)].a) else s end as cs, case when len(tm) > 0 then least(tm[1].b, e) else e end as ce from (
      select *, list_filter(hit, lambda z: z.b >= m0 and z.a <= m1) as tm from (
        select *, list_filter(masks, lambda z: z.b >= s and z.a <= e) as hit from (
          select *, greatest(end_, coalesce(f0, end_)) as s, coalesce(f1, end_) as e, case when f0 is null then -1.0 else coalesce(sc, ms) end as score from (
            select * exclude (s, e), coalesce(g0, case when s is not null then {_TWO_START} end) as f0, coalesce(g1, case when s is not null then se end) as f1 from (
              select *, {_TWO_END} as se from (
                select * exclude (e0), greatest(s, e0) as e from (
                  select o3.*, r.end_, case when b0 is not null then greatest(b0, coalesce(r.got, b0)) end as s, case when b0 is not null then least(b1, later) end as e0 from r join o3 on o3.user_id = r.user_id and o3.k = r.k + 1)))))))))
select user_id, cast(k - 1 as integer) as word, round(start_, 3) as start_s, round(end_, 3) as end_s, round(score, 6) as score from r where k > 0""")
