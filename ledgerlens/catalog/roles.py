"""Check-SQL twins of the role views in ``sources.testtables``."""

from ledgerlens.catalog.registry import R, cte

BAND = "CASE WHEN {0}>=0.8 THEN 'CRITICAL' WHEN {0}>=0.6 THEN 'HIGH' WHEN {0}>=0.3 THEN 'MEDIUM' ELSE 'LOW' END"

cte(
    "r_areas",
    """SELECT c_custkey o_custkey, c_name mp_name, c_mktsegment constituency, n_name state, r_name house
       FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
)
cte(
    "r_works",
    """SELECT concat_ws('|',o_orderkey,mp_name,constituency,state) project_id, CAST(o_orderkey AS VARCHAR) work_id,
       o_orderpriority||' lot '||(o_orderkey%4) work_description,
       CASE WHEN o_orderkey%53<>0 THEN o_orderpriority END category, mp_name, constituency, state, house,
       CASE WHEN o_orderkey%67<>0 THEN o_totalprice END recommended_amount,
       CASE WHEN o_orderkey%61<>0 THEN o_orderdate END recommendation_date,
       o_orderkey%3=0 has_images, 'IDA-'||(o_custkey%10) ida
       FROM orders JOIN r_areas USING (o_custkey)""",
)
cte(
    "r_completions",
    f"""SELECT CAST(l_orderkey AS VARCHAR) work_id, {R("l_extendedprice*(1-l_discount)", 2)} final_amount,
       l_shipdate completed_date, CAST(l_linenumber%5+1 AS DOUBLE) average_rating
       FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_orderstatus='F'""",
)
cte(
    "r_payments",
    """SELECT mp_name, constituency, state, house, o_orderpriority||' -- LOT #'||(o_orderkey%4) work_description,
       s_name vendor, 'IDA-'||(o_custkey%10) ida, l_extendedprice expenditure_amount, l_shipdate expenditure_date,
       CASE l_returnflag WHEN 'A' THEN 'successful' WHEN 'N' THEN 'pending' ELSE 'cancelled' END payment_status
       FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN r_areas USING (o_custkey)
       JOIN supplier ON l_suppkey=s_suppkey""",
)
cte(
    "r_mp",
    f"""SELECT mp_name, constituency, state, house, allocated_amount,
       {R("coalesce(spent,0)*1.3e0", 2)} total_expenditure, {R("coalesce(spent,0)*130e0/allocated_amount", 4)} utilization_pct,
       completed_works, recommended_works, {R("completed_works*100e0/recommended_works", 4)} completion_rate_pct,
       {R("allocated_amount-coalesce(spent,0)*1.3e0", 2)} unspent_amount, recommended_works transaction_count,
       completed_works successful_payments, pending_payments,
       {R("CAST(rating_sum AS DOUBLE)/recommended_works", 2)} average_rating
       FROM (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) allocated_amount,
         CAST(sum(CASE WHEN o_orderstatus<>'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) spent,
         count(*) FILTER (o_orderstatus='F') completed_works, count(*) recommended_works,
         count(*) FILTER (o_orderstatus='P') pending_payments, sum(o_orderkey%5+1) rating_sum
         FROM orders GROUP BY 1) JOIN r_areas USING (o_custkey)""",
)
cte(
    "r_descriptions",
    """SELECT concat_ws('|',doc_id,'MP '||(doc_id%50),source,lang) project_id, text work_description,
       'cat'||(doc_id%4) category, lang state, source constituency, 'MP '||(doc_id%50) mp_name,
       CAST((doc_id*7919)%9000+1000 AS DOUBLE) recommended_amount FROM documents""",
)
cte(
    "r_events",
    """SELECT 'ev-'||(CASE WHEN event_id%40=39 THEN event_id-1 ELSE event_id END) event_id,
       CASE event_type WHEN 'signup' THEN 'project_recommended' WHEN 'purchase' THEN 'PAYMENT_RECEIVED'
         WHEN 'click' THEN 'PAYMENT_STATUS_UPDATED' WHEN 'view' THEN 'PROJECT_STATUS_UPDATED'
         ELSE 'PROJECT_COMPLETED' END event_type,
       strftime(ts,'%Y-%m-%dT%H:%M:%S.%fZ') event_timestamp,
       CASE WHEN event_id%97=0 THEN 'unknown_feed' ELSE 'historical_replay' END event_source,
       k AS project_id, CASE WHEN event_id%83<>0 THEN 'MP '||(CAST(k AS BIGINT)%7) END mp_name,
       'State '||(CAST(k AS BIGINT)%4) state, 'Area '||(CAST(k AS BIGINT)%11) constituency,
       CASE WHEN event_type='signup' THEN value END recommended_amount,
       CASE WHEN event_type='purchase' THEN CASE WHEN event_id%71=0 THEN -value ELSE value END END expenditure_amount,
       CASE WHEN event_type='error' THEN value END final_amount,
       CASE WHEN event_type IN ('purchase','click') THEN
         (['Payment Success','payment in-progress','Pending','bounced','cancelled'])
         [CASE WHEN event_id%50=0 THEN 3 ELSE event_id%3 END + 1] END payment_status,
       CASE WHEN event_type='view' THEN CASE WHEN user_id%2=0 THEN 'in_progress' ELSE 'on_hold' END END project_status,
       CASE WHEN event_type='error' THEN strftime(ts,'%Y-%m-%d') END completed_date,
       CASE WHEN event_id%59=0 THEN 'ambiguous' WHEN event_id%61=0 THEN 'unresolved' ELSE 'resolved' END mapping_status,
       event_id seq
       FROM (SELECT *, json_extract_string(props,'$.k') k FROM events)""",
)
TAGS = """CASE WHEN event_id%6=event_id%5 THEN [({w})[event_id%6+1]] ELSE [({w})[event_id%6+1],({w})[event_id%5+1]] END""".format(
    w="['stalled','quality','cost','ghost','other','noise']"
)
cte(
    "r_votes",
    f"""SELECT event_id action_id, user_id citizen_id, json_extract_string(props,'$.k') work_id,
       CASE WHEN event_id%4<>0 THEN {TAGS} END reasons FROM events WHERE event_type IN ('click','view')""",
)
cte(
    "r_creports",
    f"""SELECT event_id report_id, user_id citizen_id, json_extract_string(props,'$.k') work_id, {TAGS} criteria,
       CASE WHEN event_id%3<>0 THEN event_id%7 END satisfaction, 'note '||event_id AS comment
       FROM events WHERE event_type='error'""",
)
cte(
    "r_civic",
    f"""SELECT *, {BAND.format("overall_risk_score")} risk_category FROM (
       SELECT CAST(c_custkey AS VARCHAR) work_id, c_name mp_name, c_mktsegment constituency, n_name state,
       'Work of '||c_name work_description, abs(c_acctbal) recommended_amount,
       (c_custkey*7919)%10001/10000e0 overall_risk_score FROM customer JOIN nation ON c_nationkey=n_nationkey)""",
)
cte(
    "r_actions",
    """SELECT event_id action_id, CASE WHEN event_type='purchase' THEN event_id ELSE user_id*13%2000 END report_id,
       CASE event_type WHEN 'purchase' THEN 'CREATE' WHEN 'signup' THEN 'ACK' ELSE 'CLEAR' END AS action,
       json_extract_string(props,'$.k') work_id,
       (['MP','District Magistrate','State Nodal Officer','MoSPI Audit Cell','Nobody'])[event_id%5+1] target_role,
       CASE WHEN event_id%2=0 THEN 'see '||event_id END AS comment, CASE WHEN event_id%3=0 THEN '{}' END AS snapshot
       FROM events WHERE event_type IN ('purchase','signup','error')""",
)
cte(
    "r_coords",
    """SELECT project_id, 'NATION_'||s state, constituency,
       CASE WHEN n%23<>0 THEN 10e0+(n*7919%4001)/2000e0 END latitude,
       CASE WHEN n%23<>0 THEN 70e0+(n*104729%6007)/2000e0 END longitude, n%17=0 location_is_synthetic,
       CASE n%5 WHEN 0 THEN 'real' WHEN 1 THEN 'Official_Source' ELSE 'manual' END location_source, n%7=0 is_verified
       FROM (SELECT 'C'||c_custkey project_id, c_custkey n, c_nationkey s, c_mktsegment constituency FROM customer
       UNION ALL SELECT 'S'||s_suppkey, s_suppkey, s_nationkey, 'SUPPLY' FROM supplier)""",
)
cte(
    "r_hashes",
    """SELECT item_id, project_id, left(h,64-k)||translate(right(h,k),'01','10') h FROM (SELECT unnest([
       struct_pack(item_id:=vec_id,project_id:=CAST(label AS VARCHAR),k:=0),
       struct_pack(item_id:=vec_id+1000000000,project_id:=CAST(label+1 AS VARCHAR),k:=vec_id%7),
       struct_pack(item_id:=vec_id+2000000000,project_id:=CAST(label AS VARCHAR),k:=vec_id%9)],recursive:=true), h
       FROM (SELECT vec_id, label, list_reduce(list_transform(embedding[1:64], lambda x: CASE WHEN x>0 THEN '1' ELSE '0' END), lambda a, b: a||b) h FROM embeddings))""",
)
cte(
    "r_risk",
    f"""SELECT *, {BAND.format("overall_risk_score")} risk_category,
       {",".join(f"{e}_risk_score IS NOT NULL {e}_available, coalesce({e}_risk_score>=0.5,false) {e}_risk_flag" for e in ("cost", "delay", "payment", "rule", "similarity", "iforest"))}
       FROM (SELECT concat_ws('|',o_orderkey,mp_name,constituency,state) project_id, CAST(o_orderkey AS VARCHAR) work_id,
       mp_name, state, constituency, house, CASE WHEN o_orderkey%53<>0 THEN o_orderpriority END category,
       o_orderpriority||' lot '||(o_orderkey%4) work_description,
       CASE WHEN o_orderstatus='F' THEN 'completed' ELSE 'in_progress' END status,
       CAST(o_orderstatus='F' AS BIGINT) is_completed, o_totalprice recommended_amount,
       {R("o_totalprice*((o_orderkey*37)%150)/100e0", 2)} total_expenditure,
       {R("((o_orderkey*37)%150)/100e0", 4)} expenditure_ratio,
       (o_orderkey*7919%10001)/10000e0 overall_risk_score, (o_orderkey*31%10001)/10000e0 cost_risk_score,
       CASE WHEN o_orderkey%11<>0 THEN (o_orderkey*57%10001)/10000e0 END delay_risk_score,
       (o_orderkey*91%10001)/10000e0 payment_risk_score, (o_orderkey*113%10001)/10000e0 rule_risk_score,
       CASE WHEN o_orderkey%13=0 THEN (o_orderkey*131%10001)/10000e0 END similarity_risk_score,
       (o_orderkey*171%10001)/10000e0 iforest_risk_score,
       (['Cost','Delay','Payment'])[o_orderkey%3+1]||' (Score: 0.50, Weight: 60.0%); '||
       (['Rule','Iforest'])[o_orderkey%2+1]||' (Score: 0.40, Weight: 40.0%)' top_risk_signals
       FROM orders JOIN r_areas USING (o_custkey))""",
)
