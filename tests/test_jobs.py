import os

from auditlens.plans import jobs


def _csv(path, text, enc="utf-8"):
    path.write_bytes(text.encode(enc))
    return str(path)


def _read_csv_dir(d):
    parts = sorted(f for f in os.listdir(d) if f.startswith("part-") and f.endswith(".csv"))
    lines = []
    for f in parts:
        with open(os.path.join(d, f), encoding="utf-8") as fh:
            body = fh.read().splitlines()
        lines += body[1:] if lines else body
    return lines


def test_audit_job_from_csv(spark, tmp_path):
    m = _csv(tmp_path / "m.csv", "Call ID,Auditor,Verdict,Buyer Name,Lead Tag\n123.0,Ann,yes,Correct,Missing\n"
                                 "124,,no,NA,Hallucination\n125,Bob,Skipped,x,x\n")
    a = _csv(tmp_path / "a.csv", "call_id,Call Verdict,buyerName,LeadTag\n123,Yes,Inferred,Missing\n"
                                 "124,no,INCO,Correct\n", "latin-1")
    out = jobs.run_audit(spark, m, a, str(tmp_path / "rep"))
    assert out.endswith("v=1")
    b = {r.call_id: r for r in spark.read.parquet(f"{out}/binary_comparison").collect()}
    assert b["123"].buyer_name == 1 and b["123"].lead_tag == 1
    assert b["124"].buyer_name == 1 and b["124"].lead_tag == 0 and b["124"].manual_auditor == "Manual Auditor"
    assert spark.read.parquet(f"{out}/manual_summary").count() == 12
    assert jobs.run_audit(spark, m, a, str(tmp_path / "rep")).endswith("v=2")


def test_restore_job_from_csv(spark, tmp_path):
    calls = _csv(tmp_path / "calls.csv", "Call ID,Seller GLID,Caller GLID\n101,111,222\n102,333,444\n103,333,444\n"
                                         "104,777,888\n")
    audit = _csv(tmp_path / "audit.csv", "Call ID,Seller GLID,Caller GLID,Audit Column\n,111,222,A\nNaN,333,444,B\n"
                                         ",555,666,C\n999,777,888,D\n")
    out = jobs.run_restore(spark, calls, audit, str(tmp_path / "restore"))
    rows = _read_csv_dir(f"{out}/restored_audit")
    assert rows == ["Call ID,Seller GLID,Caller GLID,Audit Column", "101,111,222,A", ",333,444,B",
                    ",555,666,C", "999,777,888,D"]
    text = "".join(open(os.path.join(f"{out}/summary", f)).read() for f in os.listdir(f"{out}/summary")
                   if f.startswith("part-"))
    assert "missing_before : 3" in text and "restored : 1" in text and "still_missing : 2" in text


def test_health_job_from_csv(spark, tmp_path):
    probes = _csv(tmp_path / "p.csv", 'model,http_status,body,exception\nm1,200,{},\n'
                                      'm2,429,"{""error"": {""message"": ""slow down, rate limit""}}",\n'
                                      'whisper-1,200,{},\nm3,,,connection timeout\n')
    out = jobs.run_health(spark, probes, str(tmp_path / "health"))
    healthy = [r.model for r in spark.read.option("header", True).csv(f"{out}/healthy_models").collect()]
    broken = {r.model: r.error_type for r in spark.read.option("header", True).csv(f"{out}/broken_models").collect()}
    assert healthy == ["m1"] and broken == {"m2": "RateLimit", "m3": "Timeout"}


def test_benchmark_job_with_stub_client(spark, tmp_path):
    rows = _csv(tmp_path / "rows.csv",
                "Seller Glid,Buyer Glid,User Details,Product Details,Past Conversation,Ongoing Conversation\n"
                "1,2,Name=Ravi Company=Acme City=Pune,Steel,NaN,Hi a buyer named Ram Lal from Pune\n"
                "3,4,Company=Acme | City=Pune,Pipes,,buyer named Ram\n"
                "5,6,Name=Zed,Bolts,,x\n")
    tpl = tmp_path / "tpl.txt"
    tpl.write_text("System Prompt:\nYou are {{seller_name}} of {{seller_company}}.\n\nUser Prompt:\n"
                   "{{seller_detail}} | {{prdDetail}} | {{convintronew}} | {{origConvDetail}} -> {{buyer_name}}\n")

    def client(model, system, user):
        if model == "m2" and "Pipes" in user:
            raise RuntimeError("fatal")          # not retryable
        return {"response": f"{system}#{user}", "prompt_tokens": 1000, "completion_tokens": 10,
                "total_tokens": 1010}

    models = [("m1", "M1", 1.0, 2.0), ("m2", "M2", 0.5, 0.5)]
    out = jobs.run_benchmark(spark, rows, str(tpl), str(tmp_path / "bench"), models=models, client=client,
                             limit=2)
    cmp = {r.row_id: r for r in spark.read.parquet(f"{out}/comparison").collect()}
    assert sorted(cmp) == [0, 1]                # head(2) in input order
    assert cmp[0].m1 == ("You are Ravi of Acme.#Name=Ravi Company=Acme City=Pune | Steel |  | "
                         "Hi a buyer named Ram Lal from Pune -> Ram Lal")
    assert cmp[1].m2 == "ERROR" and cmp[1].m1.startswith("You are Seller of Company.#")
    stats = {r.model: r for r in spark.read.parquet(f"{out}/benchmark_summary").collect()}
    assert stats["m1"].success == 2 and stats["m2"].failed == 1
    assert abs(stats["m1"].avg_cost - (1000 / 1e6 * 1.0 + 10 / 1e6 * 2.0)) < 1e-15


def test_dataset_job_from_csv(spark, tmp_path):
    calls = _csv(tmp_path / "calls.csv", 'Call ID,Call Summary,call_json,inferred_details\n'
                 '1001,s,"{""a"": 1}","{""buyer_city"": ""Pune""}"\n'
                 '1001,dup,"{""a"": 2}",x\n'
                 '1002,s,"{""a"": 1}",NaN\n')
    jsons = _csv(tmp_path / "cj.csv", "Call ID,call_json\n1002,\n")
    manual = _csv(tmp_path / "m.csv", "Call ID,Transcript,Type,Verdict,Accuracy Score\n"
                  "1001,hello,manual,Yes,100.0\n1002,hi,Manual,No,n/a\n")
    out = jobs.run_dataset(spark, calls, manual, jsons, str(tmp_path / "ds"))
    rej = {r.call_id: r.reject_reason for r in spark.read.option("header", True).csv(f"{out}/rejects").collect()}
    assert rej == {"1001": None, "1002": "inferred_details"}
    ds = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/dataset")
    row = ds.collect()[0]
    assert row.expected_output == '{\n  "verdict": "Yes",\n  "accuracy_score": 100\n}'
    assert row.metadata == '{"call_id": "1001"}'


def test_benchmark_cli_from_response_log(spark, tmp_path):
    rows = _csv(tmp_path / "rows.csv", "Seller Glid,User Details,Product Details,Past Conversation,"
                                       "Ongoing Conversation\n1,a,b,c,d\n2,a,b,c,d\n3,a,b,c,d\n")
    tpl = tmp_path / "tpl.txt"
    tpl.write_text("System Prompt: s\nUser Prompt: u\n")
    log = _csv(tmp_path / "log.csv", "row_id,model,response,latency,prompt_tokens,completion_tokens,total_tokens,status\n"
                                     "0,alpha-lite,hi,1.5,100,10,110,Success\n"
                                     "1,alpha-lite,ERROR,3.0,NA,NA,NA,Failed\n"
                                     "0,beta-nano,yo,0.5,200,20,220,Success\n")
    jobs.main(["benchmark", "--rows", rows, "--template", str(tpl), "--responses", log,
               "--out", str(tmp_path / "b"), "--limit", "0"])
    out = str(tmp_path / "b" / "v=1")
    stats = {r.model: r for r in spark.read.parquet(f"{out}/benchmark_summary").collect()}
    assert stats["alpha-lite"].requests == 2 and stats["alpha-lite"].failed == 1
    assert stats["alpha-lite"].avg_latency == 2.25 and stats["alpha-lite"].avg_prompt_tokens == 100.0
    cmp = spark.read.parquet(f"{out}/comparison")
    assert cmp.count() == 3
    r0 = [r for r in cmp.collect() if r["alpha-lite"] == "hi"]
    assert len(r0) == 1 and r0[0]["beta-nano"] == "yo" and r0[0]["gamma-26b"] == "ERROR"
