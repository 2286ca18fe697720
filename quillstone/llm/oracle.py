"""SQL equivalents (DuckDB) of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from ..functions.normalise import STAND_INS

_STAND = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)
_SQUEEZE = "trim(regexp_replace({0}, '[\\s\\x{{00A0}}\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))"


def _ok(c: str) -> str:
    return f"coalesce(lower({_SQUEEZE.format(c)}) not in ({_STAND}), false)"


def _any(c: str) -> str:
    return f"coalesce(len(list_filter({c}, lambda x: {_ok('x')})) > 0, false)"


def _base(c: str) -> str:
    s = f"regexp_replace(regexp_replace(upper({c}), '[^\\p{{L}}\\p{{Nd}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"nullif(regexp_replace(regexp_extract({s}, '^(CVE_?\\d{{4}}_\\d+)(?:_AUGU?MENTED_?\\d*)?$', 1), '^CVE_?', 'CVE_'), 'CVE_')"


def oracle_sql() -> dict[str, str]:
    moment = """case
        when regexp_matches(u, '^-?\\d{12,}$') then cast(u as bigint) * 1000
        when regexp_matches(u, '^-?\\d+$') then cast(u as bigint) * 1000000
        when regexp_matches(u, '^\\d{4}-') then epoch_us(try_cast(u as timestamptz))
        when regexp_matches(u, '^\\d{4}/') then epoch_us(try_strptime(u, '%Y/%m/%d %H:%M:%S'))
        else epoch_us(try_strptime(u, '%d %b %Y %H:%M UTC')) end"""
    p1 = f"""
        with c as (
            select {_base('input_id')} b, record_sha256 s, raw_text, labels, json_extract_string(provenance, '$.severity') sev,
                case when json_type(provenance, '$.affected') = 'ARRAY' then cast(json_extract(provenance, '$.affected') as varchar[])
                     else [json_extract_string(provenance, '$.affected')] end aff,
                trim(json_extract_string(provenance, '$.updated_at')) u, coalesce(p.trust, -1000000) trust
            from records r left join source_specs p on r.source_name = p.source_name),
        d as (select distinct b, s, {_ok('raw_text')} o1, {_any('labels')} o2, {_ok('sev')} o3, {_any('aff')} o4, trust, coalesce({moment}, -99999999999999999) us
              from c where b is not null),
        g as (select b, max(o1) o1, max(o2) o2, max(o3) o3, max(o4) o4, max(trust) trust, max(us) us from d group by b having count(distinct s) > 1)
        select distinct d.b as base_input_id, d.s as record_sha256 from d join g using (b, o1, o2, o3, o4, trust, us)"""
    p2 = f"""
        with r as (
            select {_base('input_id')} i, technique_id t, scored_at,
                case when score_text >= 0 and isfinite(score_text) then score_text end a,
                case when mean_edge_score between 0 and 1 then mean_edge_score end b,
                case when mode = 'full' and llm_score between 0 and 1 or mode = 'structure' and llm_score between 0 and 100
                     or mode in ('evidence', 'generic') and llm_score between -10 and 10 then llm_score end c,
                case when path_cost >= 0 and path_cost < 1000000 then -path_cost end d
            from rerank),
        k as (select * from (select *, row_number() over (partition by i, t order by scored_at desc nulls last, a desc nulls last, b desc nulls last, c desc nulls last, d desc nulls last) n from r) where n = 1),
        x as (select i, t, {', '.join(f"{s} is not null and rank() over (partition by i order by {s} desc nulls last) = 1 and count(*) over (partition by i, {s}) = 1 f{s}, {s} is not null and rank() over (partition by i order by {s} desc nulls last) <= 2 g{s}" for s in 'abcd')} from k)
        select i as input_id, t as technique_id from x
        where cast(fa as int) + cast(fb as int) + cast(fc as int) + cast(fd as int) >= 3 and ga and gb and gc and gd"""
    labels = ("directly_supported", "inferential_or_plausible", "insufficient_text", "unsupported")
    clean = "trim(regexp_replace(regexp_replace(lower(d), '^\\s*[(\\[]?\\d+[)\\]]?\\s*[-.:)]*\\s*', ''), '[^\\p{L}]+', '_', 'g'), '_')"
    read = "case " + " ".join(f"when levenshtein(k, '{x}') <= 2 then '{x}'" for x in labels) + " end"
    votes = f"""
        with e as (
            select sample_id, submitted_at, form_id, 0 as role, reviewer_1_id w, reviewer_1_decision d from audit_reviews
            union all select sample_id, submitted_at, form_id, 1, reviewer_2_id, reviewer_2_decision from audit_reviews
            union all select sample_id, submitted_at, form_id, 2, adjudicator_id, adjudicated_decision from audit_reviews),
        k as (select *, {clean} k from e where {_ok('w')} and {_ok('sample_id')} and d is not null),
        v as (select * from (select *, {read} dec from k) where dec is not null),
        l as (select * from (select *, row_number() over (partition by sample_id, trim(w) order by submitted_at desc nulls last, form_id desc, role desc) n from v) where n = 1)"""
    p4 = f"""{votes}
        select sample_id, dec as decision from (select sample_id, dec, count(*) c, sum(count(*)) over (partition by sample_id) n from l group by 1, 2)
        where n >= 3 and 2 * c > n"""
    p4_agreement = f"""{votes},
        c as (select sample_id, dec, count(*) c, sum(count(*)) over (partition by sample_id) m from l group by 1, 2),
        u as (select sample_id, any_value(m) m, sum(c * c) cc from c where m >= 2 group by 1),
        t as (select dec, sum(c) c from c where m >= 2 group by 1),
        ex as (select sum(c) n, sum(c * c) sq from t)
        select cast((select count(*) from u) as bigint) as n_samples, cast((select sum(m) from u) as bigint) as n_votes,
            round(1 - (select sum((m * m - cc) / (m - 1)) from u) / ((n * n - sq) / (n - 1)), 9) as alpha from ex"""
    adv = "nullif(regexp_extract(regexp_replace(regexp_replace(upper(advisory_id), '[^\\p{L}\\p{Nd}]+', '_', 'g'), '^_+|_+$', '', 'g'), '^ADV_?(\\d{8})$', 1), '')"
    p6 = f"""
        with recursive n as (select row_id, coalesce({_base('base_input_id')}, {_base('source_id')}) b, nullif({adv}, '00000000') a from source_rows),
        e as (select distinct b, a from n where b is not null and a is not null),
        hop as (select distinct x.b f, y.b t from e x join e y on x.a = y.a),
        reach(f, t) as (select b, b from (select distinct b from n where b is not null) union select r.f, h.t from reach r join hop h on r.t = h.f),
        lead as (select b, min(row_id) m from n group by b),
        root as (select f b, min(m) g from reach join lead on reach.t = lead.b group by f),
        rows_of as (select row_id, coalesce(g, row_id) g from n left join root using (b))
        select g as group_row_id, row_id from rows_of where g <> row_id"""
    # whole quotas: rounded down, the rest by largest fraction; the split meets them to the row and parts no group
    p6_shares = """
        with n as (select count(*) n from source_rows), s(i, name, tenths) as (values (0, 'train', 8), (1, 'validation', 1), (2, 'test', 1)),
        q as (select i, name, n, n * tenths // 10 w, n * tenths % 10 f from n, s),
        o as (select *, row_number() over (order by f desc, i) k, n - sum(w) over () short from q)
        select name as assigned_split, cast(w + case when k <= short then 1 else 0 end as bigint) as wanted_rows,
            cast(w + case when k <= short then 1 else 0 end as bigint) as n_rows, cast(0 as bigint) as n_parted from o"""
    p9_lines = """
        with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 unit_no from documents where text is not null),
        s as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by unit_no rows between unbounded preceding and 1 preceding), 0) pos,
              regexp_replace(line, '^[\\s\\x{0085}\\x{00A0}\\x{2028}\\x{2029}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', '') led from l),
        u as (select doc_id, unit_no, pos + length(line) - length(led) st, regexp_replace(led, '[\\s\\x{0085}\\x{00A0}\\x{2028}\\x{2029}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+$', '') unit from s)
        select doc_id, cast(unit_no as int) as unit_no, cast(st as bigint) as "start", cast(st + length(unit) as bigint) as "end",
            row_number() over (partition by unit order by doc_id, unit_no) = 1 as keep from u where length(unit) >= 1"""
    return {"p1_found": p1, "p2_found": p2, "p4_found": p4, "p4_agreement": p4_agreement, "p6_found": p6, "p6_shares": p6_shares, "p9_lines": p9_lines}
