"""Explicit schemas of the model tables and of the nested report payload."""

from __future__ import annotations

EXTRACTION_META = """struct<
  retry_stats:struct<retry_count:int,tables_retried:int,input_tokens:bigint,output_tokens:bigint,
    elapsed_seconds:double,cost_sek:double>,
  validation:struct<
    tables:struct<is_valid:boolean,error_count:int,warning_count:int,
      errors:array<struct<table_id:string,table_title:string,error_type:string,message:string,row_index:int>>>,
    sections:struct<is_valid:boolean,error_count:int,warning_count:int,
      warnings:array<struct<section_id:string,section_title:string,warning_type:string,message:string>>>>,
  total_cost_sek:double,
  total_elapsed_seconds:double,
  passes:array<struct<pass:int,model:string,input_tokens:bigint,output_tokens:bigint,elapsed_seconds:double,cost_sek:double>>,
  pass1_counts:struct<tables:int,sections:int,charts:int>,
  missing_tables:array<struct<table_id:string,table_title:string,page:string,type:string>>>"""

TABLE_ROW = """struct<label:string,label_en:string,note_ref:string,values:array<string>,`order`:int,type:string,indent:int>"""
CHART_POINT = "struct<label:string,value:decimal(28,6),segment:string>"

COMPANIES = "id string, name string, slug string, created_at timestamp"
PERIODS = f"""id string, company_id string, quarter int, year int, valuta string, language string, pdf_hash string,
  source_file string, extraction_meta {EXTRACTION_META}, extraction_status string, tables_count int,
  sections_count int, charts_count int, embeddings_count int, cost_sek decimal(10,4),
  extraction_time_seconds decimal(10,2), error_count int, warning_count int, created_at timestamp, updated_at timestamp"""
FINANCIAL_DATA = """id string, period_id string, statement_type string, row_order int, row_name string,
  value decimal(28,6), row_type string"""
SECTIONS = """id string, period_id string, title string, page_number int, section_type string, content string,
  embedding array<float>"""
REPORT_TABLES = f"""id string, period_id string, table_key string, entity string, title string, page_number int,
  table_type string, columns array<string>, rows array<{TABLE_ROW}>"""
CHARTS = f"""id string, period_id string, title string, page_number int, chart_type string, x_axis string,
  y_axis string, estimated boolean, data_points array<{CHART_POINT}>, image_path string"""
LABEL_SYNONYMS = "synonym string, canonical string"
KNOWLEDGE = """id string, domain string, category string, title string, content string, tags array<string>,
  related_metrics array<string>, source string, embedding array<float>, created_at timestamp, updated_at timestamp"""
EXTRACTION_ERRORS = """id string, period_id string, error_type string, severity string, component string,
  details string, resolved boolean, created_at timestamp"""
EXTRACTION_LOGS = """period_id string, company_id string, log_level string, module string, message string,
  metadata string, ts timestamp"""
JOB_EVENTS = "job_id string, batch_id string, status string, cost_sek double, ts timestamp"
FILE_EVENTS = "batch_id string, path string, outcome string, error string, ts timestamp, total_files int"
FILE_INVENTORY = "path string, folder string, name string, md5_12 string"

MODEL_TABLES = {
    "companies": COMPANIES,
    "periods": PERIODS,
    "financial_data": FINANCIAL_DATA,
    "sections": SECTIONS,
    "report_tables": REPORT_TABLES,
    "charts": CHARTS,
    "label_synonyms": LABEL_SYNONYMS,
    "knowledge": KNOWLEDGE,
    "extraction_errors": EXTRACTION_ERRORS,
    "extraction_logs": EXTRACTION_LOGS,
    "job_events": JOB_EVENTS,
    "file_events": FILE_EVENTS,
    "file_inventory": FILE_INVENTORY,
}

_LEGACY_ROW = "struct<rad:string,namn:string,varde:decimal(28,6),typ:string>"
PAYLOAD = f"""struct<
  metadata:struct<bolag:string,period:string,valuta:string,sprak:string,number_format:string,antal_sidor:int>,
  tables:array<struct<id:string,title:string,type:string,entity:string,page:int,currency:string,columns:array<string>,
    rows:array<{TABLE_ROW}>,footnotes:array<string>>>,
  sections:array<struct<id:string,title:string,page:int,type:string,content:string>>,
  charts:array<struct<id:string,title:string,page:int,chart_type:string,x_axis:string,y_axis:string,estimated:boolean,
    data_points:array<{CHART_POINT}>,image_path:string>>,
  resultatrakning:array<{_LEGACY_ROW}>,
  balansrakning:array<{_LEGACY_ROW}>,
  kassaflodesanalys:array<{_LEGACY_ROW}>,
  _source_file:string,
  _pipeline_info:{EXTRACTION_META}>"""

# Output of every data-quality rule.
FINDING_COLUMNS = ["report", "item_id", "title", "error_type", "message", "row_index", "severity"]
