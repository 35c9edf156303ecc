"""DuckDB statements for the queries whose results need a checksum of texts."""

from __future__ import annotations

_POLYNOMIAL = 0xEDB88320


def _nibbles() -> list[int]:
    """The remainders of the sixteen half bytes."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


def crc32(text: str) -> str:
    """An expression for the unsigned crc32 of a text: half a byte a step, the lower half first."""
    digits = f"hex({text})"
    halves = (
        f"list_transform(range(1, length({digits}) + 1), lambda i: "
        f"instr('0123456789ABCDEF', {digits}[i + (i % 2) * 2 - 1]) - 1)"
    )
    table = f"[{', '.join(map(str, _nibbles()))}]::bigint[]"
    step = f"lambda c, v: xor(c >> 4, ({table})[(xor(c, v) & 15) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {halves}), {step}), 4294967295)"


CONVERSATION_REPAIR = rf"""
with recursive damaged as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as said,
           {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as how
    from conversations
), rows as (
    select conv_id, turn, case when how = 4 then 'user' else role end as role,
           case how when 1 then '' when 2 then regexp_replace(said, '[.!?]', '', 'g') else said end as said
    from damaged, (values (0), (1)) copies(copy) where how <> 0 and (copy = 0 or how = 3)
), placed as (
    select *, left(role, 1) as initial,
           row_number() over (partition by conv_id order by turn nulls first, role, said) as pos
    from rows
), facts as (
    select *, lag(initial) over (partition by conv_id order by pos) as before,
           case when not regexp_matches(said, '[^\x20\x09-\x0D]') then 'blank'
                when row_number() over (partition by conv_id, role, said order by pos) > 1 then 'duplicate'
                when regexp_matches(said, '[.!?][\x20\x09-\x0D]*$') then '' else 'truncated' end as fault
    from placed
), counts as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
           count_if(fault = 'truncated') as truncated,
           count_if(before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
    from facts group by conv_id
), inserts(place, then_place, cost, letters, lines) as (
    values (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
           (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
           (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), edits(place, letter, initial, cost, then_place) as (
    values (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3),
           (0, 'R', null, 1, 2), (1, 'R', null, 1, 2), (3, 'R', null, 1, 2), (2, 'R', null, 1, 3),
           (0, 'D', null, 2, 0), (1, 'D', null, 2, 1), (2, 'D', null, 2, 2), (3, 'D', null, 2, 3)
), best as (
    select conv_id, 0::bigint as pos, 0 as place, {{'cost': 0, 'audit': '', 'lines': []::varchar[]}} as b from counts
    union all
    select p.conv_id, f.pos, e.then_place, min({{
        'cost': p.b.cost + i.cost + e.cost + case when e.letter <> 'D' and f.fault = 'truncated' then 5 else 0 end,
        'audit': p.b.audit || i.letters || e.letter,
        'lines': p.b.lines || i.lines || case e.letter when 'D' then []::varchar[] when 'K' then [f.role || ':' || f.said]
                 else [case e.then_place when 2 then 'user:' else 'assistant:' end || f.said] end}})
    from best p join facts f on p.conv_id is not distinct from f.conv_id and f.pos = p.pos + 1
    join inserts i on i.place = p.place join edits e on e.place = i.then_place
    where (e.letter <> 'K' or e.initial = f.initial) and (e.letter = 'D' or f.fault not in ('blank', 'duplicate'))
    group by p.conv_id, f.pos, e.then_place
), done as (
    select p.conv_id, min({{'cost': p.b.cost + i.cost, 'audit': p.b.audit || i.letters, 'lines': p.b.lines || i.lines}}) as b
    from best p join counts c on p.conv_id is not distinct from c.conv_id and p.pos = c.n
    join inserts i on i.place = p.place where i.then_place in (0, 3) group by p.conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
       coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(d.b.cost, 0)::bigint as cost, coalesce(d.b.audit, '') as audit,
       sha256(coalesce(array_to_string(d.b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on o.conv_id is not distinct from c.conv_id
left join done d on o.conv_id is not distinct from d.conv_id"""

SPELLING_VARIANTS = f"""
with recursive runs as (
    select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
    from (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{6,}}')) as run
          from documents)
    group by all
), hashed as (
    select run, c, {crc32("id || ':' || run")} as h from runs
), words as (
    select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word,
           sum(c)::bigint as n
    from hashed group by 1 having length(word) >= 6 and sum(c) >= 5
), less as (
    select word, n, length(word) as l, p, left(word, p::int) || substr(word, p::int + 2) as rest
    from words, unnest(range(length(word))) t(p)
), near as (
    select a.word, b.word as other, b.n from less a join less b on a.rest = b.rest and a.p = b.p and a.l = b.l and a.word <> b.word
    union select a.word, b.word, b.n from less a join words b on a.rest = b.word
    union select b.word, a.word, a.n from less a join words b on a.rest = b.word
), best as (
    select word, count(*) as n_near, min({{'less': -n, 'other': other}}) as b from near group by word
), formed as (
    select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
           case when -b.b.less >= 5 * w.n then b.b.other end as form, case when -b.b.less >= 5 * w.n then (-b.b.less)::bigint end as form_n
    from words w left join best b on w.word = b.word
), chain as (
    select word, coalesce(form, word) as root, form is not null as on_ from formed
    union all
    select c.word, coalesce(f.form, c.root), f.form is not null from chain c join formed f on f.word = c.root where c.on_
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n
from formed f join chain c on c.word = f.word and not c.on_"""
