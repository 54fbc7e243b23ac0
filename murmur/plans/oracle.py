"""The queries of ``queries.py`` in DuckDB SQL, written from the semantics.

``VIEWS`` repeats ``views.py``; ``sql(...)`` puts the views a query needs in
front of it.
"""

from __future__ import annotations

import re

NOW = "timestamp '2024-01-31 00:00:00'"

VIEWS = {
    "posts": """
        select d.source as stock,
               case d.doc_id % 3 when 0 then 'reddit' when 1 then 'stocktwit' else 'twitter' end as source,
               case when d.doc_id % 3 = 0 then null else 'u' || (d.doc_id % 37) end as "user",
               d.text, d.lang,
               case when d.doc_id % 3 <> 1 then null when d.doc_id % 5 < 2 then 'Bullish'
                    when d.doc_id % 5 < 4 then 'Bearish' else '' end as directional,
               d.doc_id as seq,
               timestamp '2024-01-31 00:00:00' - to_hours(d.doc_id % 240) - to_minutes(30) as ts,
               e.embedding as logits
        from documents d join embeddings e on e.vec_id = d.doc_id % (select count(*) from embeddings)""",
    "english_posts": """
        select * from posts where source = 'reddit' or (lang in ('en', 'pl') and text <> '')""",
    "scored_posts": """
        select * exclude (logits, text),
               case source when 'reddit' then 0 when 'stocktwit' then 1 else 2 end as ord,
               {clean:text} as text,
               {net:logits} as probability
        from english_posts where {clean:text} <> ''""",
    "comments": """
        select e.event_id as seq, e.ts,
               case e.event_type when 'error' then '[removed]' when 'view' then '' when 'click' then ' '
                    when 'signup' then 'https://a.example/b?c=1' else d.text end as body
        from events e join documents d on d.doc_id = e.event_id % (select count(*) from documents)""",
    "news": """
        select e.event_id as id, e.event_type as ticker, e.ts, d.text as headline, d.lang, e.value as score
        from events e join documents d on d.doc_id = e.event_id % (select count(*) from documents)""",
    "prices": """
        select event_type as ticker, cast(ts as date) as date, max_by(value, ts) as adj_close
        from events where isodow(ts) < 6 group by 1, 2""",
    "companies": """
        select p_partkey as pos, 'P' || p_partkey as symbol,
               p_name || ' Corp. A, ' || p_brand || ' Inc.' as title, p_size as short_pct from part""",
    "names": """
        select pos, symbol, title, short_pct, upper(symbol) as keyword, {company:title} as name from companies""",
    "caps": """
        select 'P' || p_partkey as symbol,
               case p_partkey % 5 when 0 then 'N/A'
                    when 1 then cast(cast(p_retailprice as decimal(18, 2)) as varchar) || 'M'
                    when 2 then '1.5B' when 3 then '2T' else '12k' end as cap_text,
               p_size as short_pct from part""",
    "cap_values": """
        select symbol, cap_text, short_pct,
               try_cast(left(cap_text, length(cap_text) - 1) as double)
               * case right(cap_text, 1) when 'T' then 1e12 when 'B' then 1e9 when 'M' then 1e6 end as cap
        from caps""",
    "trending": """
        select page_id, unnest(range(len(s))) as pos, unnest(s) as symbol, unnest(t) as title
        from (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as s,
                     regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as t from pages)""",
    "gaps": """
        select * from (select ticker, date, lead(date) over (partition by ticker order by date) as next_date
                       from prices) where next_date is not null""",
    "session_scores": """
        select g.ticker, g.date, g.next_date, count(*) as nb, avg(n.score) as sentiment
        from gaps g join news n
          on n.ticker = g.ticker and n.ts >= g.date + interval '9 hours 30 minutes'
         and n.ts < g.date + interval '9 hours 30 minutes' + to_days(datediff('day', g.date, g.next_date))
        group by all having count(*) >= 15""",
    "returns": """
        select ticker, date, adj_close,
               adj_close / nullif(lag(adj_close) over (partition by ticker order by date), 0) - 1 as daily_return
        from prices""",
    "returns_sentiment": """
        select r.*, s.sentiment from returns r
        left join session_scores s on s.ticker = r.ticker and s.next_date = r.date""",
    "holidays": """
        select unnest([date '2024-01-01', date '2024-01-15']) as date""",
    # Staged de-duplication, source by source as the posts arrive.
    "after_reddit": """
        select * from scored_posts where ord = 0
        qualify row_number() over (partition by stock, text order by ord, seq) = 1""",
    "stocktwit_texts": """
        select * from (select * from after_reddit union all by name select * from scored_posts where ord = 1)
        qualify row_number() over (partition by stock, text order by ord, seq) = 1""",
    "after_stocktwit": """
        select * from stocktwit_texts where "user" is null
        union all by name
        (select * from stocktwit_texts where "user" is not null
         qualify row_number() over (partition by stock, "user" order by ord, seq) = 1)""",
    "twitter_texts": """
        select * from (select * from after_stocktwit union all by name select * from scored_posts where ord = 2)
        qualify row_number() over (partition by stock, text order by ord, seq) = 1""",
    "staged": """
        select * from twitter_texts where "user" is null
        union all by name
        (select * from twitter_texts where "user" is not null
         qualify row_number() over (partition by stock, "user" order by ord, seq) = 1)""",
    "after_stocktwit_collapse": """
        select * from stocktwit_texts
        qualify row_number() over (partition by stock, "user" order by ord, seq) = 1""",
    "twitter_texts_collapse": """
        select * from (select * from after_stocktwit_collapse
                       union all by name select * from scored_posts where ord = 2)
        qualify row_number() over (partition by stock, text order by ord, seq) = 1""",
    "staged_collapse": """
        select * from twitter_texts_collapse
        qualify row_number() over (partition by stock, "user" order by ord, seq) = 1""",
    "searches": """
        select event_type as ticker, cast(ts as date) as date, max(ts) as now,
               case when event_type in ('view', 'click') then 6 else 168 end as lookback
        from events group by 1, 2""",
    "busy": "select * from names where short_pct between 20 and 39",
    "shorted": """
        select pos, symbol, short_pct, keyword, name || ' Holdings' as name from names where short_pct >= 30""",
}

# Stopwords per language.
STOPWORDS = {
    "en": "the and of to in is that for with as was on are by this",
    "fr": "le la les et des que un une est pour dans qui du aux avec",
    "de": "der die das und ist nicht ein eine mit für auf den zu von sich",
    "es": "el la los las y que en un una es por con para del se",
    "it": "il lo gli che di non per una sono con della nel come anche più",
    "pt": "o os as que não uma para com do da em por mais dos são",
    "nl": "de het een en van niet dat zijn voor met op aan ook naar bij",
}


def _clean(text: str) -> str:
    out = f"regexp_replace(lower({text}), '\\n\\p{{Nd}}', ' ', 'g')"
    out = f"replace({out}, chr(10), ' ')"
    out = f"regexp_replace({out}, 'https?://[a-zA-Z0-9@:%._/+~#=?&;-]*', ' ', 'g')"
    return f"replace({out}, '  ', ' ')"


def _net(logits: str) -> str:
    """Softmax of the first three, positive less negative; fine for small logits."""
    a, b, c = (f"exp(cast({logits}[{i}] as double))" for i in (1, 2, 3))
    return f"({c} - {a}) / ({a} + {b} + {c})"


def _company(title: str) -> str:
    out = title
    for word in ("limited", "Limited", "Inc.", "INC", "Corporation", "Corp.", "Corp", "Co.", "Ltd", "ltd", ","):
        out = f"replace({out}, '{word}', '')"
    return f"list_aggregate(list_filter(regexp_split_to_array({out}, '\\s+'), lambda w: length(w) > 1), 'string_agg', ' ')"


_MACROS = {"clean": _clean, "net": _net, "company": _company}


def _expand(text: str) -> str:
    return re.sub(r"\{(clean|net|company):([^}]*)\}", lambda m: _MACROS[m[1]](m[2]), text)


def sql(body: str) -> str:
    """``body`` behind the views it names, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(from|join|,)\s+\(?{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    views = ",\n".join(f"{name} as ({_expand(VIEWS[name])})" for name in needed)
    return (f"with {views}\n" if views else "") + _expand(body).strip()


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 as {name}"


def _alnum(char: str) -> str:
    return f"regexp_matches({char}, '[\\p{{L}}\\p{{N}}]')"


def _keyword_sql(rules: tuple) -> str:
    """First occurrence stands alone; first listed keyword of the stock that hits."""
    left = "case when hit > 1 then substr(text, hit - 1, 1) else '' end"
    right = "substr(text, hit + length(keyword), 1)"
    values = ", ".join(f"('{stock}', {place}, '{keyword}')" for stock, place, keyword in rules)
    return sql(f"""
        select doc_id, stock, keyword from (
            select d.doc_id, d.text, k.stock, k.place, k.keyword, instr(d.text, k.keyword) as hit
            from documents d cross join (values {values}) k(stock, place, keyword))
        where hit > 0 and not {_alnum(left)} and not {_alnum(right)}
        qualify row_number() over (partition by doc_id, stock order by place) = 1""")


_SINGLE = (("THE", 0, "The"), ("IS", 0, "Is"), ("ON", 0, "on"))
_MULTI = (
    ("ARTICLES", 0, "The"),
    ("ARTICLES", 1, "la"),
    ("ARTICLES", 2, "of the"),
    ("PREPOSITIONS", 0, "of the"),
    ("PREPOSITIONS", 1, "on"),
    ("PREPOSITIONS", 2, "in"),
    ("MARKS", 0, "$$$"),
    ("MARKS", 1, "Is"),
)


def _keyword_any_sql(rules: tuple) -> str:
    """Any occurrence stands alone: the text is padded, and the hit checked with its neighbours."""
    edge = "[^\\p{L}\\p{N}]"
    each = "\nunion all ".join(
        f"""select doc_id, '{stock}' as stock, {place} as place, '{keyword}' as keyword from documents
            where regexp_matches(' ' || text || ' ', '{edge}{keyword.replace("$", "[$]")}{edge}')"""
        for stock, place, keyword in rules
    )
    return f"""
        select doc_id, stock, keyword from ({each})
        qualify row_number() over (partition by doc_id, stock order by place) = 1"""


def _metrics_sql(posts: str) -> str:
    per_source = ", ".join(
        f"count(*) filter (where source = '{s}') as nb_{s}, "
        + _r(f"avg(probability) filter (where source = '{s}')", f"avg_{s}")
        for s in ("reddit", "stocktwit", "twitter")
    )
    return sql(f"""
        select stock, count(*) as total_nb, {_r('avg(probability)', 'total_avg')},
               cast(null as double) as accuracy, {per_source}
        from {posts} group by stock""")


def _sliding_sql() -> str:
    """Each lookback computed from all posts anew."""
    per_source = ", ".join(
        f"count(*) filter (where source = '{s}') as nb_{s}, " + _r(f"avg(probability) filter (where source = '{s}')", f"avg_{s}")
        for s in ("reddit", "stocktwit", "twitter")
    )
    spans = " union all ".join(
        f"""select {end} as days_ago, stock, count(*) as total_nb, {_r('avg(probability)', 'total_avg')},
            cast(null as double) as accuracy, {per_source} from scored_posts
            where ts >= {NOW} - to_days({end + 3}) and ts < {NOW} - to_days({end}) group by stock"""
        for end in (8, 6, 4, 2, 0)
    )
    return sql(f"select * from ({spans})")


def _histogram_sql(view: str, score: str) -> str:
    return sql(f"""
        select b.bin, count(s.x) as n, {_r('any_value(lo) + b.bin * any_value(hi - lo) / 50', 'left_edge')},
               {_r('any_value(lo) + (b.bin + 1) * any_value(hi - lo) / 50', 'right_edge')}
        from (select unnest(range(50)) as bin) b
        cross join (select min({score}) as lo, max({score}) as hi from {view}) e
        left join (select {score} as x from {view} where {score} is not null) s
          on least(cast(floor((s.x - e.lo) / (e.hi - e.lo) * 50) as bigint), 49) = b.bin
        group by b.bin""")


def _age(now: str, hours: str) -> str:
    return (
        f"case when {hours} = 1 then '1 hour ago' when {hours} between 2 and 23 then {hours} || ' hours ago' "
        f"else strftime({now} - to_hours({hours}), '%b %-d') end"
    )


def _post_time(at: str, now: str) -> str:
    return (
        f"case when cast({at} as date) = cast({now} as date) then strftime({at}, '%I:%M %p') "
        f"else strftime({at}, '%-m/%-d/%y') end"
    )


def _language_sql() -> str:
    counts = ", ".join(
        "len(list_filter(words, lambda w: list_contains([{}], w))) as {}".format(
            ", ".join(f"'{w}'" for w in listed.split()), f"n_{lang}"
        )
        for lang, listed in STOPWORDS.items()
    )
    best = "greatest({})".format(", ".join(f"n_{lang}" for lang in STOPWORDS))
    picks = " ".join(f"when n_{lang} = {best} then '{lang}'" for lang in STOPWORDS)
    latin = r"length(regexp_replace(text, '\P{Latin}', '', 'g'))"
    others = r"length(regexp_replace(text, '[\P{L}\p{Latin}]', '', 'g'))"
    # RE2 has no look-around: the characters beside a ticker are taken along, twice for neighbours that share one
    ticker = r"'(^|[^\p{L}\p{N}])\p{Lu}{2,5}($|[^\p{L}\p{N}])', '\1 \2', 'g')"
    rest = rf"regexp_replace(regexp_replace(regexp_replace(text, '\$\p{{L}}+', ' ', 'g'), {ticker}, {ticker}"
    terse = rf"regexp_matches(text, '\p{{L}}') and len(regexp_extract_all({rest}, '\p{{L}}+')) <= 8"
    return rf"""
        select doc_id, lang,
               case when {others} > {latin} then 'xx' when {best} > 0 then case {picks} end when {terse} then 'en' end as found
        from (select doc_id, lang, text, {counts}
              from (select doc_id, lang, text, regexp_extract_all(lower(text), '\p{{L}}+') as words from documents))"""


_LEXICON = "('the', 0.4), ('is', -1.1), ('on', 1.9), ('la', -0.8), ('der', 2.3), ('of', -0.3), ('not', -2.0)"


def _lexicon_views(source: str, key: str, text: str) -> str:
    return f"""
        select w.{key}, coalesce(sum(l.valence), 0.0) as total
        from (select {key}, unnest(case when len(found) = 0 then [''] else found end) as token
              from (select {key}, regexp_extract_all(lower({text}), '\\p{{L}}+') as found from {source})) w
        left join (select token, cast(valence as double) as valence from (values {_LEXICON}) v(token, valence)) l
          on l.token = w.token group by w.{key}"""


_LEARNED = r"""
        with padded as (select doc_id, lang, doc_id % 5 = 0 as held_out,
                        regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '\P{L}+', ' ', 'g') as t from documents),
        grams as (select doc_id, lang, held_out, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) as gram from padded),
        per_doc as (select doc_id, lang, held_out, gram, count(*) as n from grams group by all),
        counts as (select lang, gram, sum(n) as n from per_doc where not held_out and lang is not null group by all),
        kept as (select gram from counts group by gram order by sum(n) desc, gram limit 50000),
        known as (select c.* from counts c join kept using (gram)),
        totals as (select lang, sum(n) as total, (select count(*) from kept) as size from known group by lang),
        weights as (select k.gram, k.lang, ln((n + 1) / (total + size + 1)) as weight from known k join totals using (lang)),
        scores as (
            select d.doc_id, t.lang as found, sum(d.n * coalesce(w.weight, ln(1 / (total + size + 1)))) as score
            from per_doc d cross join totals t left join weights w on w.gram = d.gram and w.lang = t.lang group by all)
        select p.doc_id, p.lang, s.found, p.held_out
        from padded p left join (select * from scores qualify row_number() over (partition by doc_id order by score desc, found) = 1) s using (doc_id)"""


_MODIFIERS = {"negations": "to en", "stronger": "that it", "weaker": "for with", "contrast": "and und"}


def _rules_sql() -> str:
    """The score by rules over documents: a word's context by the words before it in order."""
    listed = lambda kind: ", ".join(f"'{w}'" for w in _MODIFIERS[kind].split())
    value = "v0"
    steps = []
    for d, share in ((1, 1.0), (2, 0.95), (3, 0.9)):
        steps.append(
            f"s{d} as (select *, case when b{d} = 9 then v{d - 1} * -0.74 "
            f"else v{d - 1} + sign(v{d - 1}) * coalesce(b{d}, 0.0) * {share} end as v{d} from {'met' if d == 1 else f's{d - 1}'})"
        )
        value = f"v{d}"
    return rf"""
        with w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '\p{{L}}+(?:''\p{{L}}+)*') as ws from documents),
        words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
        kinds as (select *, lower(word) as low, word = upper(word) and word <> lower(word) as caps from words),
        texts as (select doc_id, bool_or(caps) and bool_or(not caps) as mixed, min(i) filter (low in ({listed('contrast')})) as turn
                  from kinds group by doc_id),
        weighed as (
            select k.*, mixed, turn, case when low in ({listed('negations')}) or low like '%n''t' then 9.0
                when low in ({listed('stronger')}) then 0.293 + case when mixed and caps then 0.733 else 0.0 end
                when low in ({listed('weaker')}) then -0.293 + case when mixed and caps then 0.733 else 0.0 end else 0.0 end::double as b
            from kinds k join texts using (doc_id)),
        context as (select *, lag(b, 1) over o as b1, lag(b, 2) over o as b2, lag(b, 3) over o as b3
                    from weighed window o as (partition by doc_id order by i)),
        met as (
            select c.*, valence + case when mixed and caps then sign(valence) * 0.733 else 0.0 end as v0
            from context c join (select token, cast(valence as double) as valence from (values {_LEXICON}) v(token, valence)) l
              on l.token = c.low and c.low not in ({listed('negations')}, {listed('stronger')}, {listed('weaker')})),
        {", ".join(steps)},
        sums as (select doc_id, sum({value} * case when turn is null or i = turn then 1.0 when i < turn then 0.5 else 1.5 end) as s from s3 group by doc_id),
        marks as (
            select doc_id, 0.292 * least(4, len(regexp_extract_all(coalesce(text, ''), '!'))) as shouts,
                len(regexp_extract_all(coalesce(text, ''), '\?')) as asks from documents),
        totals as (
            select doc_id, coalesce(s, 0.0) + sign(coalesce(s, 0.0)) * (shouts + case when asks > 3 then 0.96 when asks > 1 then 0.18 * asks else 0.0 end) as total
            from marks left join sums using (doc_id))
        select doc_id, {_r('total / sqrt(total * total + 15)', 'compound')} from totals"""


_LETTERS = """
        select *, cast((length({0}) - length(replace({0}, 'e', ''))) / 100 as float)::double as neg,
                  cast((length({0}) - length(replace({0}, 'a', ''))) / 100 as float)::double as posi"""


def _letter_score() -> str:
    return "(exp(posi) - exp(neg)) / (exp(posi) + 1 + exp(neg))"


def _social_sql() -> str:
    """The social job: match, parse, language, clean, staged de-duplication, score, metrics."""
    keywords = _keyword_sql(_SINGLE)
    found = _language_sql().replace("documents", "searched").replace("doc_id, lang", "rid")
    means = ", ".join(
        f"count(*) filter (where k.source = '{s}') as nb_{s}, "
        + _r(f"avg(k.p) filter (where k.source = '{s}')", f"avg_{s}")
        for s in ("reddit", "stocktwit", "twitter")
    )
    stock = "case conv_id % 3 when 0 then 'THE' when 1 then 'IS' else 'ON' end"
    first = "qualify row_number() over (partition by stock, {} order by ord, seq) = 1"
    return f"""
    with matched as ({keywords}),
    reddit as (
        select m.stock, 'reddit' as source, 0 as ord, cast(null as varchar) as "user", d.text, d.doc_id as seq
        from matched m join documents d on d.doc_id = m.doc_id),
    searched as (
        select {stock} as stock, case when role = 'user' then 'stocktwit' else 'twitter' end as source,
               case when role = 'user' then 1 else 2 end as ord, 'user' || conv_id as "user",
               case when role <> 'user' then replace(text, chr(10), ' ')
                    when turn % 3 < 2 then text else '10:05 AM' || chr(10) || text end as text,
               conv_id * 1000 + turn as seq, conv_id * 1000 + turn as rid
        from conversations),
    languages as ({found}),
    english as (
        select s.* exclude (rid) from searched s join languages l on l.rid = s.rid
        where l.found in ('en', 'pl') and s.text <> ''),
    cleaned as (
        select * exclude (text), {_clean('text')} as text
        from (select * from reddit union all by name select * from english) where {_clean('text')} <> ''),
    t1 as (select * from cleaned where ord <= 1 {first.format('text')}),
    u1 as (select * from t1 where "user" is null union all by name
           (select * from t1 where "user" is not null {first.format('"user"')})),
    t2 as (select * from (select * from u1 union all by name select * from cleaned where ord = 2) {first.format('text')}),
    u2 as (select * from t2 where "user" is null union all by name
           (select * from t2 where "user" is not null {first.format('"user"')})),
    scored as (select *, {_letter_score()} as p from ({_LETTERS.format('text')} from u2))
    select u.stock, count(k.seq) as total_nb, {_r('avg(k.p)', 'total_avg')}, cast(null as double) as accuracy, {means}
    from (values ('THE'), ('IS'), ('ON'), ('SILENT')) u(stock) left join scored k on k.stock = u.stock
    group by u.stock"""


def _news_vs_return_sql() -> str:
    found = _language_sql().replace("documents", "cleaned").replace("doc_id, lang", "id").replace("text", "headline")
    return sql(f"""
    select * from (
    with firsts as (
        select * from news where headline is not null and trim(headline) <> ''
        qualify row_number() over (partition by ticker, headline order by id) = 1),
    cleaned as (select id, ticker, ts, {_headline('headline')} as headline from firsts),
    languages as ({found}),
    english as (select c.* from cleaned c join languages l on l.id = c.id where l.found = 'en'),
    totals as ({_lexicon_views('english', 'id', 'headline')}),
    scored as (select e.ticker, e.ts, total / sqrt(total * total + 15) as compound
               from english e join totals t on t.id = e.id),
    bars as (select * from prices where date between date '2024-01-03' and date '2024-01-29'
             and extract(day from date) <> 17),
    r as (select *, adj_close / lag(adj_close) over w - 1 as daily_return, lead(date) over w as next_date
          from bars window w as (partition by ticker order by date)),
    s as (select r.ticker, r.next_date, avg(compound) as sentiment
          from r join scored n on n.ticker = r.ticker
           and n.ts >= r.date + interval '9 hours 30 minutes' and n.ts < r.next_date + interval '9 hours 30 minutes'
          where r.next_date is not null group by 1, 2 having count(*) >= 5)
    select r.ticker, r.date, {_r('r.adj_close', 'adj_close')}, {_r('r.daily_return', 'daily_return')},
           {_r('s.sentiment', 'sentiment')}
    from r left join s on s.ticker = r.ticker and s.next_date = r.date)""")


def _headline(text: str) -> str:
    out = f"regexp_replace({text}, 'https?://.*[\\r\\n]*', '', 'g')"
    out = f"replace({out}, '#', '')"
    return f"regexp_replace({out}, '@[^\\s\\p{{Z}}]+', '', 'g')"


def _holiday_sql() -> str:
    return """
        select cast(month(o_orderdate) as varchar) as holiday, cast(min(o_orderdate) as date) as date
        from orders group by month(o_orderdate), year(o_orderdate)"""


ORACLE = {
    # Scans, sources, sinks
    "posts_lookback": sql(f"""
        select seq, ts, body from comments
        where ts >= {NOW} - interval 168 hours and ts < {NOW} and body <> '[removed]'"""),
    "cap_input": sql(f"""
        select seq, ts from comments
        where ts >= {NOW} - interval 720 hours and ts < {NOW} and body <> '[removed]' order by ts, seq limit 1000"""),
    "parse_twitter_post": """
        select conv_id, turn, 'user' || conv_id as "user", replace(text, chr(10), ' ') as text from conversations""",
    "parse_stocktwits_post": """
        select conv_id, turn, 'user' || conv_id as "user",
               case turn % 3 when 0 then 'Bullish' when 1 then 'Bearish' else '' end as directional,
               case when turn % 3 < 2 then text else '10:05 AM' || chr(10) || text end as text
        from conversations""",
    "news_load": """
        select event_type as ticker, event_type as category, cast(floor(epoch(ts)) as bigint) as datetime,
               event_type || ' ' || props as headline, event_id as id, '' as image, event_type as related,
               'wire' as source, props as summary, 'https://n.example/' || event_id as url
        from events""",
    "trending_flatten": sql("select page_id, cast(pos as int) as pos, symbol, title from trending"),
    "trending_top_n": sql("select page_id, cast(pos as int) as pos, symbol from trending where pos < 5"),
    "html_rows": """
        select page_id, cast(row_no as int) as row_no, cast(len(items) as int) as nb,
               array_to_string(list_transform(items, lambda c: replace(replace(replace(replace(replace(replace(
                   regexp_replace(c, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                   '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '|') as cells
        from (select page_id, unnest(range(len(l))) as row_no,
                     unnest(list_transform(l, lambda x: regexp_extract_all(x, '(?s)<li>(.*?)</li>', 1))) as items
              from (select page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) as l from pages))""",
    "page_caps": sql("select symbol, cap_text from caps"),
    "screener_rows": sql("""
        select pos // 20 as page, cast(row_number() over (partition by pos // 20 order by pos) as int) as row_no,
               symbol as ticker, replace(title, ',', ' &') as company from companies"""),
    "screener_rows_lenient": sql("""
        select pos // 20 as page, cast(row_number() over (partition by pos // 20 order by pos) as int) as row_no,
               symbol as ticker, replace(title, ',', ' &') as company from companies"""),
    "index_members": sql("""
        select pos // 20 as page, cast(row_number() over (partition by pos // 20 order by pos) as int) as row_no,
               cast(pos as varchar) as ticker from companies"""),
    "holiday_unpivot": _holiday_sql(),
    "metrics_csv_roundtrip": _metrics_sql("staged"),
    # Projections, filters
    "lang_filter_lenient": sql("select stock, source, seq, lang from english_posts"),
    "lang_filter_strict": sql("select id, ticker, lang from news where lang = 'en'"),
    "lang_filter_strict_by_value": sql("""
        select id, ticker, lang from news n
        anti join (select distinct ticker, sha256(headline) as digest from news where lang is distinct from 'en') f
          on f.ticker = n.ticker and f.digest = sha256(n.headline)"""),
    "drop_empty_clean": sql("select seq, {clean:body} as body from comments where {clean:body} <> ''"),
    "news_drop_blank": sql("""
        select id, ticker, length(headline) as chars from news
        where score >= 2 and hour(ts) <> 3 and trim(headline) <> ''"""),
    "dropna_any": """
        select d.doc_id, d.source, l.quality, l.toxic from documents d join labels l on l.doc_id = d.doc_id
        where d.source is not null and l.quality is not null and l.toxic is not null""",
    "price_range": sql(f"""
        select ticker, date, {_r('adj_close', 'adj_close')} from prices
        where date between date '2024-01-08' and date '2024-01-19'"""),
    "adjusted_close": sql(f"""
        select ticker, date, {_r('adj_close', 'adj_close')} from prices
        where date between date '2024-01-08' and date '2024-01-26' and extract(day from date) <> 17"""),
    "min_cap_filter": sql("select symbol, cap_text, cap from cap_values where cap >= 500e6"),
    "short_level_filter": sql("select symbol, short_pct from caps where short_pct >= 30"),
    # Joins
    "keyword_match": _keyword_sql(_SINGLE),
    "keyword_match_multi": _keyword_sql(_MULTI),
    "keyword_match_large_universe": _keyword_sql(_MULTI),
    "keyword_match_any": _keyword_any_sql(_MULTI),
    "news_sessions": sql(f"""
        select ticker, date, next_date, nb, {_r('sentiment', 'sentiment')} from session_scores"""),
    "headline_sessions": sql("""
        select n.id, g.ticker, g.date, g.next_date from gaps g join news n
          on n.ticker = g.ticker and n.ts >= g.date + interval '9 hours 30 minutes'
         and n.ts < g.next_date + interval '9 hours 30 minutes'"""),
    "table_grid": """
        select page_id, "row", col, text from (
            select s_nationkey as page_id, cast(row_number() over (partition by s_nationkey order by s_suppkey) - 1 as int) as "row",
                   [cast(s_nationkey as varchar), s_name, '#' || s_suppkey] as cells from supplier) r,
            (select unnest(range(3))::int as col) c, lateral (select cells[col + 1] as text)""",
    "headlines_in_spans": sql("""
        select n.id, g.ticker, g.date, g.next_date, g.opens, g.closes from (
            select *, date + case when extract(day from date) % 3 = 0 then to_hours(6 + extract(day from date) % 7) + to_minutes(extract(day from date) % 5 * 11)
                           else interval '9 hours 30 minutes' end as opens,
                   next_date + case when extract(day from next_date) % 3 = 0
                           then to_hours(6 + extract(day from next_date) % 7) + to_minutes(extract(day from next_date) % 5 * 11)
                           else interval '9 hours 30 minutes' end as closes from gaps) g
        join news n on n.ticker = g.ticker and n.ts >= g.opens and n.ts < g.closes"""),
    "sentiment_next_return": sql(f"""
        select ticker, date, {_r('adj_close', 'adj_close')}, {_r('daily_return', 'daily_return')},
               {_r('sentiment', 'sentiment')} from returns_sentiment"""),
    "stock_lookback": """
        select 'P' || p_partkey as stock, case when p_size >= 25 then p_size >= 40 end as is_trending,
               cast(case when p_size >= 40 then 6 else 168 end as int) as lookback from part""",
    "posts_lookback_by_stock": sql(f"""
        select stock, source, seq, ts from posts
        where ts < {NOW} and ts >= {NOW} - to_hours(
            case when source = 'reddit' or regexp_matches(stock, '[02468]$') then 6 else 168 end)"""),
    "open_days": sql(f"""
        select ticker, date, {_r('adj_close', 'adj_close')} from prices
        where date not in (select date from holidays)"""),
    "holiday_days": sql(f"""
        select ticker, date, {_r('adj_close', 'adj_close')} from prices
        where date in (select date from holidays)"""),
    # Aggregations, de-duplication
    "nb_comments": sql("""
        select t.stock, s.source, count(p.seq) as nb
        from (select distinct stock from scored_posts) t
        cross join (values ('reddit'), ('stocktwit'), ('twitter')) s(source)
        left join scored_posts p on p.stock = t.stock and p.source = s.source group by 1, 2"""),
    "average_sentiment": sql(f"""
        select t.stock, s.source, {_r('avg(p.probability)', 'avg')}
        from (select distinct stock from scored_posts) t
        cross join (values ('reddit'), ('stocktwit'), ('twitter')) s(source)
        left join scored_posts p on p.stock = t.stock and p.source = s.source group by 1, 2"""),
    "stock_sentiment_metrics": _metrics_sql("staged"),
    "stock_sentiment_metrics_collapse": _metrics_sql("staged_collapse"),
    "metrics_rollup": sql(f"""
        select stock, source, count(*) as nb, {_r('avg(probability)', 'avg')} from scored_posts
        group by grouping sets ((stock, source), (stock))"""),
    "dedup_text": sql("""
        select stock, source, seq from scored_posts
        qualify row_number() over (partition by stock, text order by ord, seq) = 1"""),
    "dedup_user": sql("""
        select stock, source, seq from scored_posts
        qualify "user" is null or row_number() over (partition by stock, "user" order by ord, seq) = 1"""),
    "dedup_user_collapse": sql("""
        select stock, source, seq from scored_posts
        qualify row_number() over (partition by stock, "user" order by ord, seq) = 1"""),
    "dedup_staged": sql("""select stock, source, "user", text, seq from staged"""),
    "dedup_staged_collapse": sql("select stock, source, seq from staged_collapse"),
    "dedup_single_pass": sql("""
        select stock, source, seq from (
            select * from scored_posts qualify row_number() over (partition by stock, text order by ord, seq) = 1)
        qualify row_number() over (partition by stock, "user" order by ord, seq) = 1"""),
    "news_dedup": sql("select min(id) as id, ticker from news group by ticker, headline"),
    "return_sentiment_corr": sql(f"""
        select ticker, count(*) filter (where daily_return is not null and sentiment is not null) as nb,
               {_r('corr(daily_return, sentiment)', 'corr')} from returns_sentiment group by ticker"""),
    "sentiment_histogram": _histogram_sql("session_scores", "sentiment"),
    "post_sentiment_histogram": _histogram_sql("scored_posts", "probability"),
    "directional_accuracy": sql(f"""
        select stock, count(*) as nb_tagged,
               {_r("avg(case when directional = 'Bullish' then (probability > 0)::int else (probability < 0)::int end)", 'accuracy')}
        from scored_posts where directional in ('Bullish', 'Bearish') group by stock"""),
    # Windows, top-k, set operations
    "daily_return": sql(f"""
        select ticker, date, {_r('adj_close', 'adj_close')}, {_r('daily_return', 'daily_return')} from returns"""),
    "session_gap": sql("""
        select ticker, date, next_date, cast(datediff('day', date, next_date) as int) as gap from gaps"""),
    "take_until_repeat": """
        with seen as (select o_orderkey as pos, 'C' || o_custkey as ticker,
                             row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
        select pos, ticker from seen where pos < coalesce((select min(pos) from seen where n = 2), 9e18)""",
    "posts_union": sql("""
        select stock, source, "user", seq, directional from posts"""),
    "universe_merge": sql("""
        select coalesce(b.symbol, s.symbol) as symbol, b.symbol is not null as is_trending,
               coalesce(s.name, b.name) as name, coalesce(s.keyword, b.keyword) as keywords
        from busy b full join shorted s on s.symbol = b.symbol"""),
    "universe_except": sql("select symbol, name from busy where symbol not in (select symbol from shorted)"),
    # Scalar functions
    "clean_post": "select doc_id as seq, " + _clean("text") + " as text from documents",
    "clean_headline": "select doc_id, " + _headline("text") + " as headline from documents",
    "normalize_company": sql("select symbol, name, keyword from names"),
    "net_sentiment": f"select vec_id, {_r(_net('embedding'), 'probability')} from embeddings",
    "parse_market_cap": sql("select symbol, cap_text, cap from cap_values"),
    "age_label": f"""
        select event_id, {_age(NOW, 'h')} as label
        from (select event_id, cast(floor((epoch({NOW}) - floor(epoch(ts))) / 3600) as bigint) as h from events)""",
    "post_time_label": f"""
        select event_id, {_post_time('ts', "timestamp '2024-01-30 23:59:59'")} as label from events""",
    "label_spine": sql(f"""
        select ticker, date, place, {_age('now', 'hours')} as label
        from (select ticker, date, now, cast(i as int) as place,
                     case when lookback + i < 24 then lookback + i
                          when lookback < 24 then 23 + 24 * (i - (24 - lookback))
                          else lookback + 24 * i end as hours
              from searches cross join (select unnest(range(59)) as i))"""),
    "post_time_spine": sql(f"""
        select ticker, date, cast(i as int) as place, {_post_time('seen', 'now')} as label
        from (select ticker, date, now, i, start - case when today then to_minutes(i) else to_days(i) end as seen
              from (select *, unnest(range(case when today then hour(start) * 60 + minute(start) + 1 else 40 end)) as i
                    from (select *, now - to_hours(lookback) as start,
                                 cast(now - to_hours(lookback) as date) = cast(now as date) as today
                          from searches)))"""),
    "day_spine": """
        select user_id, cast(datediff('day', start, stop) as int) as days,
               cast(unnest(generate_series(start, stop, interval 1 day)) as date) as date
        from (select user_id, cast(min(ts) as date) as start, cast(max(ts) as date) as stop
              from events group by user_id)""",
    "lookback_hours": sql("""
        select event_id, cast(ts as date) as date,
               cast(24 + case when isodow(ts) = 1 then 48 else 0 end
                    + case when h.date is null then 0 when isodow(ts) = 2 then 48 else 24 end as int) as hours
        from events left join holidays h on h.date + 1 = cast(ts as date)"""),
    # Scoring, decisions
    "score_posts_batch": sql(f"""
        select stock, source, seq, {_r(_letter_score(), 'probability')} from (
            {_LETTERS.format('body')}
            from (select stock, source, seq, {{clean:text}} as body from english_posts) where body <> '')"""),
    "detect_language": _language_sql(),
    "lexicon_score": f"""
        select doc_id, {_r('total / sqrt(total * total + 15)', 'compound')}
        from ({_lexicon_views('documents', 'doc_id', 'text')})""",
    "detect_language_learned": _LEARNED,
    "lexicon_score_rules": _rules_sql(),
    "position_signal": sql("""
        select m.stock, h.held,
               case when h.held = 'long' then case when m.total_avg * 100 > 0.2 then 'long' else 'exit' end
                    when h.held = 'short' then case when m.total_avg * 100 < -0.2 then 'short' else 'exit' end
                    when m.total_nb > 5 and m.total_avg * 100 > 0.5 then 'long'
                    when m.total_nb > 5 and m.total_avg * 100 < -0.5 then 'short' else 'none' end as signal
        from (select stock, count(*) as total_nb, avg(probability) as total_avg from staged group by stock) m
        left join (select source as stock, case max(doc_id) % 3 when 0 then 'long' when 1 then 'short' end as held
                   from documents group by source) h on h.stock = m.stock"""),
    "position_history": sql("""
        select * from (with recursive days as (
            select stock, cast(ts as date) as day, count(*) as nb, avg(probability) * 100 as percent,
                   row_number() over (partition by stock order by cast(ts as date)) as n
            from scored_posts group by 1, 2),
        walk as (
            select stock, 0 as n, cast(null as date) as day, cast(null as varchar) as held, 'none' as signal from (select distinct stock from days)
            union all
            select d.stock, d.n, d.day, h.held,
                   case when h.held = 'long' then case when d.percent > 0.2 then 'long' else 'exit' end
                        when h.held = 'short' then case when d.percent < -0.2 then 'short' else 'exit' end
                        when d.nb > 2 and d.percent > 0.9 then 'long' when d.nb > 2 and d.percent < -0.9 then 'short' else 'none' end
            from (select stock, n, case when signal in ('long', 'short') then signal end as held from walk) h
            join days d on d.stock = h.stock and d.n = h.n + 1)
        select stock, day, held, signal from walk where n > 0)"""),
    "dedup_on_arrival": sql("select stock, source, seq from staged"),
    "metrics_sliding": _sliding_sql(),
    "enough_comments": sql("select stock, count(*) as total_nb from scored_posts group by stock having count(*) > 36"),
    # Jobs
    "choose_universe": sql("""
        select n.symbol, n.short_pct >= 40 as is_trending, n.name, n.keyword as keywords, c.cap
        from names n join cap_values c on c.symbol = n.symbol where n.short_pct >= 30 and c.cap >= 500e6"""),
    "social_sentiment": _social_sql(),
    "news_vs_return": _news_vs_return_sql(),
}
