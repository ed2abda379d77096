"""Schemas of the entities, as DDL; inputs are always read with one of these."""

from __future__ import annotations

RUNTIME = (
    "url string, requests array<struct<url:string,method:string,resource_type:string,status_code:int,headers:map<string,string>>>, web_sockets array<struct<url:string>>, "
    "event_sources array<struct<url:string>>, cookies array<struct<name:string,value:string,domain:string,path:string,secure:boolean,http_only:boolean>>, "
    "local_storage array<struct<key:string,value:string>>, session_storage array<struct<key:string,value:string>>, "
    "indexed_db array<struct<database:string,version:bigint,stores:array<struct<name:string,records:array<string>>>>>, service_workers array<struct<url:string,scope:string,active:boolean>>"
)
PAGE = "url string, status_code int, content_type string, body string"
FILE = "path string, content string"
PACKAGE = "name string, version string, ecosystem string, source string"
ADVISORY = "id string, package_name string, ecosystem string, severity int, summary string, fixed_in string, introduced_in string"
VULNERABILITY = "id string, aliases array<string>, summary string, severity int, fixed_version string, affected_package string, affected_version string, ecosystem string, source string"
FINDING = "secret_type string, severity int, provider string, key string, match string, value string, source string, context string, entropy double"
NODE = "id string, type string, label string, properties map<string,string>, ingest_seq bigint"
EDGE = "id string, type string, source string, target string, label string, properties map<string,string>, ingest_seq bigint"
SCORABLE = "id string, label string, item_type string, url string, method string, name string, secret_type string, provider string, severity_int int, severity_float double"
SCOPE_ENTRY = "id string, workspace_id string, entry_type string, pattern string, created_at timestamp"
SCOPE_CONFIG = "workspace_id string, rate_limit_rps double, rate_limit_burst int, auth_type string, auth_value string, custom_headers map<string,string>, respect_robots boolean, robots_body string, created_at timestamp, updated_at timestamp"
WORKSPACE = "id string, name string, target string, root string, version int, hash string, status string, created_at timestamp, modified_at timestamp, last_scan_at timestamp, scan_count int"
ROBOTS = "host string, body string"
#: Tables of a workspace that are only declared so far.
AUDIT_LOG = "id bigint, ts timestamp, workspace_id string, event string, detail string"
JS_ASSET = "id string, workspace_id string, url string, hash string, asset_type string, source_map_url string, first_seen timestamp, last_seen timestamp"
API_RECORD = "id string, workspace_id string, method string, route string, auth_mechanism string, source_file string, source_function string, discovered_via string, confidence double"
STORED_FINDING = "id string, workspace_id string, category string, severity_score double, evidence array<string>, related_ids array<string>, created_at timestamp"
SNAPSHOT = "id string, workspace_id string, created_at timestamp, label string, asset_count int, api_count int, finding_count int, size_bytes bigint"
ASSET_BLOB = "hash string, size bigint, mime_type string, first_seen timestamp, ref_count int"
