"""Text similarity over the documents as work descriptions (whole texts), and near-equal hashes."""

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import MED, R, cte, query
from ledgerlens.functions.numbers import rounded
from ledgerlens.operators import geo, hashes, similarity
from ledgerlens.operators.similarity import STOP_WORDS

cte("s_docs", "SELECT *, trim(regexp_replace(lower(work_description),'[^a-z0-9]+',' ','g')) clean_description FROM r_descriptions")
cte("s_texts", "SELECT clean_description text, min(project_id) text_id, count(*) copies FROM s_docs WHERE clean_description<>'' GROUP BY 1")
STOP = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def vectors(prefix, grams, min_chars, usable, sublinear):
    """Check SQL for the long TF-IDF table ``<prefix>_w``."""
    w = f"list_filter(string_split(text,' '), lambda x: length(x)>={min_chars} AND NOT list_contains({STOP},x))"
    parts = ["w"] + [
        "list_transform(range(1,len(w)-{0}), lambda i: {1})".format(n - 2, "||' '||".join(f"w[i+{k}]" for k in range(n)))
        for n in range(2, grams + 1)
    ]
    listed = "w" if len(parts) == 1 else f"list_concat({parts[0]},{parts[1]})" if len(parts) == 2 else f"list_concat(list_concat({parts[0]},{parts[1]}),{parts[2]})"
    cte(f"{prefix}_tf", f"SELECT text_id, copies, term, count(*) tf FROM (SELECT text_id, copies, unnest({listed}) term FROM (SELECT text_id, copies, {w} w FROM s_texts)) GROUP BY ALL")
    cte(
        f"{prefix}_vocab",
        f"""SELECT term, df, ln((1+n)/(1e0+df))+1 idf FROM (SELECT term, sum(copies) df, (SELECT sum(copies) FROM s_texts) n FROM {prefix}_tf GROUP BY 1)
        WHERE {usable}""",
    )
    tf = "(1+ln(tf))" if sublinear else "tf"
    cte(
        f"{prefix}_w",
        f"SELECT text_id, copies, term, df, raw/sqrt(sum(raw*raw) OVER (PARTITION BY text_id)) weight FROM (SELECT *, {tf}*idf raw FROM {prefix}_tf JOIN {prefix}_vocab USING (term))",
    )


vectors("s3", 3, 1, "df>=2 AND df<=0.8*n", True)
vectors("s2", 2, 2, "true", False)
cte(
    "s_pairs",
    """SELECT a.text_id text_id_a, b.text_id text_id_b, sum(a.weight*b.weight) similarity FROM s3_w a JOIN s3_w b ON a.term=b.term AND a.text_id<b.text_id
    GROUP BY ALL HAVING sum(a.weight*b.weight)>=0.85""",
)


def docs_of(t):
    return similarity.with_clean_descriptions(t.descriptions)


def model_of(t):
    docs = docs_of(t)
    texts = similarity.numbered_texts(similarity.distinct_texts(docs))
    return docs, texts, similarity.fit_tfidf(texts, STOP_WORDS)


def pairs_of(t):
    docs, texts, model = model_of(t)
    return docs, texts, similarity.cosine_pairs(model.vectors)


@query("T01_tfidf_bigrams", f"SELECT text_id, term, {R('weight', 6)} weight FROM s2_w")
def t01(t):
    texts = similarity.numbered_texts(similarity.distinct_texts(docs_of(t)))
    model = similarity.fit_tfidf(texts, STOP_WORDS, 2, 1, 1.0, sublinear=False, min_chars=2)
    return model.weights.select("text_id", "term", rounded(F.col("weight"), 6).alias("weight"))


@query(
    "T02_nearest_similarity",
    f"""SELECT project_id, {R("CASE WHEN copies>1 THEN 1e0 ELSE coalesce(m,0e0) END", 4)} similarity FROM s_docs JOIN s_texts ON text=clean_description LEFT JOIN
    (SELECT text_id, max(s) m FROM (SELECT a.text_id, b.text_id other, sum(a.weight*b.weight) s FROM s2_w a JOIN s2_w b ON a.term=b.term AND a.text_id<>b.text_id GROUP BY ALL) GROUP BY 1) USING (text_id)""",
)
def t02(t):
    out = similarity.description_similarity(t.descriptions, STOP_WORDS)
    return out.select("project_id", rounded(F.col("description_similarity_score"), 4).alias("similarity"))


@query(
    "T03_tfidf_trigrams",
    f"SELECT text_id, count(*) terms, {R('sum(weight)', 4)} total, {R('max(weight)', 6)} top FROM s3_w GROUP BY 1",
)
def t03(t):
    _, _, model = model_of(t)
    total = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w)
    return model.vectors.select("text_id", F.size("ids").cast("long").alias("terms"), rounded(total, 4).alias("total"), rounded(F.array_max("weights"), 6).alias("top"))


SHORT = " OR ".join(f"{{0}}='{g}' OR starts_with({{0}},'{g} ')" for g in similarity.GENERIC_TEMPLATES)


def generic(x):
    return f"(length({x})<40 OR {SHORT.format(x)})"


def spec(x):
    return f"(CASE WHEN {x}='' THEN 0e0 WHEN length({x})<20 THEN 0.1e0 WHEN length({x})<40 THEN 0.3e0 WHEN length({x})<80 THEN 0.6e0 ELSE 1e0 END)"


cte(
    "s_both",
    """SELECT * FROM s_pairs UNION ALL SELECT text_id, text_id, 1e0 FROM s_texts WHERE copies>1""",
)
cte(
    "s_shown",
    f"""SELECT text_id_a project_id_a, text_id_b project_id_b, {R("similarity", 4)} similarity_score, CAST(similarity>=0.97 AS INT) exact_text_duplicate_flag,
    CAST({generic("a.text")} OR {generic("b.text")} AS INT) generic_template_pair_flag, {R(f"({spec('a.text')}+{spec('b.text')})/2", 4)} specificity_weight,
    a.text description_a, b.text description_b, left(a.text,200) shown_a, left(b.text,200) shown_b, p.state state_a, q.state state_b, p.constituency constituency_a, q.constituency constituency_b, p.mp_name mp_a, q.mp_name mp_b,
    a.copies copies_a, b.copies copies_b, p.recommended_amount cost_a, q.recommended_amount cost_b
    FROM s_both JOIN s_texts a ON a.text_id=text_id_a JOIN s_texts b ON b.text_id=text_id_b JOIN s_docs p ON p.project_id=text_id_a JOIN s_docs q ON q.project_id=text_id_b""",
)
T04_OUT = "project_id_a, project_id_b, similarity_score, exact_text_duplicate_flag, generic_template_pair_flag, specificity_weight, description_a, description_b, shown_a, shown_b, state_a, state_b, mp_a, mp_b, copies_a, copies_b"


@query("T04_duplicate_pairs", f"SELECT {T04_OUT} FROM s_shown")
def t04(t):
    docs, texts, pairs = pairs_of(t)
    return similarity.text_pairs(docs, pairs, texts).select(*T04_OUT.split(", "))


TEMPLATES = "CASE doc_id%4 WHEN 0 THEN lower(text) WHEN 1 THEN 'solar light '||lower(text) WHEN 2 THEN 'hand pump'||lower(text) ELSE lower(text)||' cc road' END"


def template_texts(t):
    n = F.col("doc_id")
    text = (
        F.when(n % 4 == 0, F.lower("text"))
        .when(n % 4 == 1, F.concat(F.lit("solar light "), F.lower("text")))
        .when(n % 4 == 2, F.concat(F.lit("hand pump"), F.lower("text")))
        .otherwise(F.concat(F.lower("text"), F.lit(" cc road")))
    )
    return t.read("documents").select("doc_id", text.alias("d"))


@query("T05_generic_template", f"SELECT doc_id, {generic('trim(d)')} is_generic FROM (SELECT doc_id, {TEMPLATES} d FROM documents)")
def t05(t):
    return template_texts(t).select("doc_id", similarity.is_generic(F.col("d")).alias("is_generic"))


@query("T06_specificity", f"SELECT doc_id, {spec('trim(d)')} weight FROM (SELECT doc_id, {TEMPLATES} d FROM documents)")
def t06(t):
    return template_texts(t).select("doc_id", similarity.specificity_weight(F.col("d")).alias("weight"))


cte(
    "s_scores",
    f"""SELECT project_id, CASE WHEN {generic("text")} THEN 0.05e0 ELSE {R(f"least(1e0,((coalesce(cr,0)+copies-1)*0.6e0+(coalesce(hi,0)+copies-1)*0.3e0)/10)*{spec('text')}", 4)} END similarity_anomaly_score
    FROM s_docs JOIN s_texts ON text=clean_description LEFT JOIN (SELECT id, sum(n) FILTER (similarity>=0.97) cr, sum(n) hi FROM (
    SELECT text_id_a id, copies n, similarity FROM s_pairs JOIN s_texts ON text_id=text_id_b UNION ALL SELECT text_id_b, copies, similarity FROM s_pairs JOIN s_texts ON text_id=text_id_a) GROUP BY 1) ON id=text_id""",
)
BANDED = "CASE WHEN similarity_anomaly_score>=0.8 THEN 'CRITICAL_DUPLICATE' WHEN similarity_anomaly_score>=0.6 THEN 'HIGH_SIMILARITY' WHEN similarity_anomaly_score>=0.4 THEN 'MEDIUM_SIMILARITY' WHEN similarity_anomaly_score>=0.1 THEN 'LOW_SIMILARITY' ELSE 'UNIQUE' END"


@query("T07_duplicate_scores", f"SELECT project_id, similarity_anomaly_score, {BANDED} similarity_risk_band FROM s_scores")
def t07(t):
    docs, texts, pairs = pairs_of(t)
    return similarity.duplicate_scores(docs, texts, pairs)


cte(
    "s_query",
    f"""SELECT query_id, term, raw/sqrt(sum(raw*raw) OVER (PARTITION BY query_id)) q FROM (SELECT query_id, term, (1+ln(count(*)))*any_value(idf) raw FROM (
    SELECT query_id, unnest(list_concat(list_concat(w,list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])),list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]))) term FROM (
    SELECT CAST(item_id AS VARCHAR) query_id, list_filter(string_split(trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g')),' '), lambda x: length(x)>=1 AND NOT list_contains({STOP},x)) w FROM benchmark)) JOIN s3_vocab USING (term) GROUP BY 1,2)""",
)


@query(
    "T08_text_search",
    f"SELECT query_id, text_id, similarity FROM (SELECT query_id, text_id, {R('sum(q*weight)', 4)} similarity FROM s_query JOIN s3_w USING (term) GROUP BY ALL) WHERE similarity>=0.2",
)
def t08(t):
    _, _, model = model_of(t)
    queries = t.read("benchmark").select(F.col("item_id").cast("string").alias("text_id"), similarity.normalize_description(F.col("text")).alias("text"))
    hits = similarity.search(queries, model, 0.1999).withColumn("similarity", rounded(F.col("similarity"), 4))
    return hits.filter("similarity >= 0.2")


@query("T09_similarity_band", f"SELECT project_id, {BANDED} band FROM (SELECT project_id, cost_risk_score similarity_anomaly_score FROM r_risk)")
def t09(t):
    return t.risk.select("project_id", similarity.similarity_band(F.col("cost_risk_score")).alias("band"))


PROBE = "(SELECT min(text_id) FROM s_texts WHERE copies=(SELECT max(copies) FROM s_texts))"


@query(
    "T10_related_projects",
    f"""SELECT {PROBE} project_id, d.project_id other_id, {R("s", 4)} similarity_score FROM (SELECT text_id_b id, similarity s FROM s_pairs WHERE text_id_a={PROBE}
    UNION ALL SELECT text_id_a, similarity FROM s_pairs WHERE text_id_b={PROBE} UNION ALL SELECT {PROBE}, 1e0) JOIN s_texts ON text_id=id JOIN s_docs d ON d.clean_description=text WHERE d.project_id<>{PROBE}""",
)
def t10(t):
    docs, texts, model = model_of(t)
    probe = texts.orderBy(F.desc("copies"), "text_id").first()["text_id"]
    return similarity.related_projects(probe, docs, texts, model)


RATIO = "CASE WHEN least(cost_a,cost_b)>0 THEN " + R("greatest(cost_a,cost_b)/least(cost_a,cost_b)", 4) + " ELSE 0e0 END"
LABEL = "CASE WHEN similarity_score<0.85 THEN 'NOT_CHECKED' WHEN cost_ratio<=0 THEN 'MISSING_COST' WHEN cost_ratio>10 THEN 'CRITICAL_BUDGET_INFLATION' WHEN cost_ratio>2 THEN 'HIGH_BUDGET_INFLATION' ELSE 'NORMAL_COST' END"
GEO = "CASE WHEN constituency_a=constituency_b AND state_a=state_b THEN 'SAME_CONSTITUENCY' WHEN state_a=state_b THEN 'SAME_STATE_DIFF_CONST' ELSE 'DIFF_STATE' END"
cte("s_cost", f"SELECT *, {LABEL} budget_anomaly_label, {GEO} geo_relationship FROM (SELECT *, {RATIO} cost_ratio FROM s_shown)")


def costed(t):
    docs, texts, pairs = pairs_of(t)
    shown = geo.annotate_pairs(similarity.text_pairs(docs, pairs, texts))
    return docs, texts, pairs, similarity.annotate_costs(shown, t.descriptions)


@query("T11_pair_costs", "SELECT project_id_a, project_id_b, cost_a, cost_b, cost_ratio, budget_anomaly_label, geo_relationship FROM s_cost")
def t11(t):
    return costed(t)[3].select("project_id_a", "project_id_b", "cost_a", "cost_b", "cost_ratio", "budget_anomaly_label", "geo_relationship")


@query(
    "T12_pair_cost_risk",
    f"""SELECT project_id, {R("least(1e0,(cost_risk_score*0.6e0+(CASE WHEN r<=1 THEN 0e0 WHEN r>=10 THEN 1e0 ELSE (r-1)/9 END)*0.4e0)*g)", 4)} risk
    FROM (SELECT *, iforest_risk_score*12 r, CASE WHEN rule_risk_score>0.5 THEN 1e0 ELSE 0.7e0 END g FROM r_risk)""",
)
def t12(t):
    weight = F.when(F.col("rule_risk_score") > 0.5, 1.0).otherwise(0.7)
    risk = similarity.pair_cost_risk(F.col("cost_risk_score"), F.col("iforest_risk_score") * 12, weight)
    return t.risk.select("project_id", risk.alias("risk"))


@query(
    "T13_peer_deviation",
    f"""SELECT project_id, amount recommended_amount, m peer_median, {R("sd", 3)} peer_std, z cost_z_score, CASE WHEN abs(z)>=3 THEN 'CRITICAL_COST' WHEN abs(z)>=2 THEN 'HIGH_COST'
    WHEN abs(z)>=1 THEN 'MEDIUM_COST' ELSE 'NORMAL_COST' END cost_deviation_label, CASE WHEN z IS NOT NULL THEN {R("least(abs(z),6e0)/6", 4)} END peer_deviation_score FROM (SELECT project_id, amount, m, sd, {R("(amount-m)/sd", 4)} z FROM
    (SELECT project_id, state, category, coalesce(recommended_amount,0e0) amount FROM r_works) w LEFT JOIN (SELECT state, category, {MED("coalesce(recommended_amount,0e0)")} m,
    CASE WHEN coalesce(stddev_samp(coalesce(recommended_amount,0e0)),1)=0 THEN 1e0 ELSE coalesce(stddev_samp(coalesce(recommended_amount,0e0)),1e0) END sd FROM r_works WHERE category IS NOT NULL GROUP BY 1,2) p
    ON p.state=w.state AND p.category=w.category)""",
)
def t13(t):
    return similarity.peer_deviation(t.works).withColumn("peer_std", rounded(F.col("peer_std"), 3))


@query(
    "A22_similarity_summary",
    f"""SELECT 'Projects in '||b metric, (SELECT count(*) FROM s_scores WHERE {BANDED}=b) "count", {R(f"(SELECT count(*) FROM s_scores WHERE {BANDED}=b)/(SELECT count(*) FROM s_scores)::DOUBLE*100", 2)} pct
    FROM (SELECT unnest(['CRITICAL_DUPLICATE','HIGH_SIMILARITY','MEDIUM_SIMILARITY','LOW_SIMILARITY','UNIQUE']) b) UNION ALL
    SELECT m, c, {R("c/greatest(1,CASE WHEN m LIKE 'Total%' THEN (SELECT count(*) FROM s_scores) ELSE total END)::DOUBLE*100", 2)} FROM (SELECT unnest([struct_pack(m:='Total duplicate pairs found',c:=total),
    struct_pack(m:='Cross-MP duplicate pairs',c:=x),struct_pack(m:='Same-constituency duplicate pairs',c:=s),struct_pack(m:='Pairs with budget inflation anomaly',c:=i)],recursive:=true), total FROM (
    SELECT sum(n)::BIGINT total, coalesce(sum(n) FILTER (mp_a<>mp_b),0)::BIGINT x, coalesce(sum(n) FILTER (geo_relationship='SAME_CONSTITUENCY'),0)::BIGINT s,
    coalesce(sum(n) FILTER (budget_anomaly_label IN ('HIGH_BUDGET_INFLATION','CRITICAL_BUDGET_INFLATION')),0)::BIGINT i
    FROM (SELECT *, CASE WHEN project_id_a=project_id_b THEN copies_a*(copies_a-1)//2 ELSE copies_a*copies_b END n FROM s_cost)))""",
)
def a22(t):
    docs, texts, pairs, shown = costed(t)
    return similarity.similarity_summary(similarity.duplicate_scores(docs, texts, pairs), shown)


# --- hashes ---------------------------------------------------------------------------------------

cte("h_distinct", "SELECT h, count(*) items, min(project_id) p0, max(project_id) p1 FROM r_hashes GROUP BY 1")
cte("h_project", "SELECT project_id, h, count(*) items FROM r_hashes GROUP BY 1,2")
HAM = "hamming(a.h,b.h)"
LIMIT = 5


def shown_hash(c):
    return F.lpad(F.bin(c), 64, "0")


@query(
    "T14_hash_duplicates",
    f"""SELECT least(a.h,b.h) hash_a, greatest(a.h,b.h) hash_b, {HAM} hamming, a.items+b.items items, {R(f"1-{HAM}/64e0", 4)} confidence FROM h_distinct a JOIN h_distinct b ON a.h<b.h AND {HAM}<={LIMIT}
    AND NOT (a.p0=a.p1 AND b.p0=b.p1 AND a.p0=b.p0) UNION ALL SELECT h, h, 0, items+items, 1e0 FROM h_distinct WHERE p0<>p1""",
)
def t14(t):
    out = hashes.cross_project_duplicates(t.hash_items, distance=LIMIT)
    a, b = shown_hash(F.col("item_hash_a")), shown_hash(F.col("item_hash_b"))
    return out.select(
        F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), "hamming", (F.col("items_a") + F.col("items_b")).alias("items"), "confidence"
    )


@query(
    "T15_project_hash_duplicates",
    f"""SELECT project_id, sum(items)::BIGINT items, (sum(items*(items-1)//2)+coalesce(any_value(near),0))::BIGINT duplicate_pairs,
    least(1e0,(sum(items*(items-1)//2)+coalesce(any_value(near),0))/sum(items)::DOUBLE) image_hash_score, CASE WHEN sum(items*(items-1)//2)+coalesce(any_value(near),0)>0 THEN 'DUPLICATES_FOUND' ELSE 'UNIQUE' END status
    FROM h_project LEFT JOIN (SELECT a.project_id, sum(a.items*b.items) near FROM h_project a JOIN h_project b ON a.project_id=b.project_id AND a.h<b.h AND {HAM}<={LIMIT} GROUP BY 1) USING (project_id) GROUP BY 1""",
)
def t15(t):
    return hashes.project_duplicates(t.hash_items, distance=LIMIT)
