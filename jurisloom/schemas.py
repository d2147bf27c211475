"""Declared schemas; nothing in the engine infers one."""

PATH = "array<struct<id:string,titre:string,debut:string,fin:string,niveau:int>>"
TEXT = (
    "struct<id:string,source_id:string,type:string,titre:string,numero:string,nor:string,autorite:string,ministere:string,"
    "date_signature:date,date_publication:date,metadata:map<string,string>>"
)
UNIT = (
    f"struct<id:string,texte_id:string,source_id:string,type:string,numero:string,ordre:int,chemin:{PATH},"
    "metadata:map<string,string>>"
)
VERSION = (
    "struct<id:string,unite_id:string,source_id:string,etat:string,date_debut:date,date_fin:date,contenu:string,nota:string,checksum_sha256:string,"
    "source_archive:string,source_path:string,metadata:map<string,string>>"
)
RELATION = (
    "struct<id:string,version_source_id:string,source_unite_id:string,type_relation:string,sens:string,cible_source_id:string,cible_texte_source_id:string,"
    "cible_numero:string,cible_nature_texte:string,cible_numero_texte:string,cible_nor_texte:string,date_signature_texte:date,libelle:string,metadata:map<string,string>>"
)
#: Row types of the tables of the national corpus.
TABLES = {"texte": TEXT, "unite": UNIT, "version": VERSION, "relation": RELATION}
ARTICLE = f"struct<reject_reason:string,texte:{TEXT},unite:{UNIT},version:{VERSION},relations:array<{RELATION}>>"
PROVISION = (
    "struct<provision_id:string,celex:string,cellar_uuid:string,kind:string,parent_id:string,ordinal:int,fmx_member:string,xml_path:string,article_label:string,"
    "paragraph_label:string,list_path:array<string>,division_path:array<string>,heading:string,text:string,fmx_tag:string>"
)
PROVISIONS = f"struct<root_tag:string,provisions:array<{PROVISION}>,warnings:array<struct<code:string,path:string>>,parse_error:string>"
INVENTORY = (
    "struct<root_tag:string,article_count:bigint,paragraph_count:bigint,point_count:bigint,tags:map<string,bigint>,celex:array<string>,eli:array<string>,parse_error:string>"
)
IDENTITY = "cellar_uuid string, status string, celex string, act_type string, same_as array<string>, method string"
ACT = "celex string, cellar_uuid string, eli string, act_type string, title string, document_date string, legal_status string, synthetic boolean"
#: Provisions under their act, as they are stored.
EU_PROVISION = PROVISION.removeprefix("struct<").removesuffix(">") + ",legal_act_celex:string,act_present:boolean"
CORPUS = "id string, code string, nom string, source_url string, source_archive string, imported_at timestamp, metadata map<string,string>"
LOG = "id string, corpus_id string, source string, started_at timestamp, finished_at timestamp, stats map<string,bigint>"
MODELS = "id string, name string, dimension int, normalise boolean"
EMBEDDINGS = "version_id string, model string, content_checksum string, embedding array<float>"
RUN = (
    "run_id string, pipeline_version string, extractor_kind string, provider string, model string, prompt_version string, jurisdiction string, source_id string, "
    "status string, outcome string, candidates bigint, rejected bigint, rejections array<string>, started_at timestamp, finished_at timestamp"
)
OBLIGATION = (
    "obligation_id string, run_id string, jurisdiction string, source_id string, source_checksum string, source_excerpt string, span_start int, span_end int, "
    "actor string, modality string, action string, object string, conditions array<string>, exceptions array<string>, deadline string, frequency string, threshold string, "
    "territorial_scope string, temporal_scope string, extractor string, raw_output string, review_status string"
)
CHECK = "obligation_id string, status string, source_checksum string, obligation_fingerprint string, validator_version string, issues array<string>, checked_at timestamp"
PAIR = (
    "eu_obligation_id string, fr_obligation_id string, eu_celex string, scope_origin string, scope_reference string, algorithm_version string, similarity double, decision string, "
    "features struct<field_jaccard:struct<action:double,object:double,actor:double>,same_modality:boolean,eu_conditions:array<string>,fr_conditions:array<string>,"
    "eu_exceptions:array<string>,fr_exceptions:array<string>>, updated_at timestamp"
)
CASCADE = (
    "jurisdiction string, source_id string, source_checksum string, policy_version string, status string, attempts int, agreement string, details string, last_error string, "
    "claimed_at timestamp, completed_at timestamp"
)
QUERY_LOG = "created_at timestamp, query string, ip_address string"
