"""Table and document schemas, as Spark DDL."""

CHUNK = (
    "collection string, chunk_id string, chunk_pos long, text string, section_heading string,"
    " image_paths array<string>, page_numbers array<int>, book_title string, book_author string,"
    " source_file string"
)
BLOCKS = "array<struct<text:string,page_idx:int>>"
CITATION = "struct<book_title:string,book_author:string,pages:array<int>>"
SNAPSHOT = (
    "struct<chunk_id:string,text:string,book_title:string,book_author:string,pages:array<int>,"
    "section_heading:string,image_paths:array<string>>"
)
ANCHOR = (
    "struct<text:string,chunk_id:string,chunk_index:int,page_numbers:array<int>,relevance_score:double>"
)
VERIFICATION = (
    "struct<quote_text:string,found:boolean,chunk_id:string,match_type:string,match_confidence:double>"
)
SOURCE_REFERENCE = (
    f"struct<summary:string,citations:array<{CITATION}>,chunk_ids:array<string>,"
    f"optimal_images:array<string>,source_chunks:array<{SNAPSHOT}>,evidence_indices:array<int>,"
    f"quotes_verified:array<{VERIFICATION}>,primary_evidence_chunk_id:string,anchor_quotes:array<{ANCHOR}>>"
)
# both the stored field names and the ones the reviewing side uses
OPTION = "struct<option_id:string,option_text:string,is_correct:boolean,explanation:string>"
ITEM = (
    "struct<item_id:string,item_type:string,title:string,learning_target:string,difficulty:string,"
    "concept_tag:string,assigned_concepts:array<string>,content:string,options:array<string>,"
    f"correct_answer_index:int,explanation:string,source_reference:{SOURCE_REFERENCE},"
    "generation_status:string,quality_flags:array<string>,question_stem:string,stem:string,"
    f"question_type:string,correct_answer:array<string>,answer_options:array<{OPTION}>>"
)
CAPSULE = (
    "struct<capsule_id:string,title:string,description:string,learning_goal:string,"
    f"capsule_type:string,estimated_duration_minutes:double,items:array<{ITEM}>,"
    "prerequisites_within_lab:array<string>,assessment_criteria:array<string>,common_errors:array<string>>"
)
LAB = (
    "struct<lab_id:string,title:string,description:string,objective:string,lab_type:string,"
    f"estimated_duration_minutes:double,tools_required:array<string>,capsules:array<{CAPSULE}>,"
    "prerequisites_within_subtopic:array<string>,success_criteria:array<string>,"
    "real_world_application:string>"
)
SUBTOPIC = (
    "struct<name:string,description:string,key_concepts:array<string>,practical_skills:array<string>,"
    f"common_misconceptions:array<string>,labs:array<{LAB}>>"
)
OBJECTIVE = "struct<objective:string,bloom_level:string,relevant_question_types:array<string>>"
TOPIC = (
    f"struct<name:string,description:string,learning_objectives:array<{OBJECTIVE}>,"
    f"subtopics:array<{SUBTOPIC}>,estimated_study_hours:double>"
)
MODULE = (
    f"struct<domain_name:string,domain_weight_pct:double,overview:string,topics:array<{TOPIC}>,"
    "prerequisites_for_domain:array<string>,recommended_study_order:array<string>,"
    "official_references:array<string>>"
)
STRATEGY = "struct<name:string,description:string,when_to_use:string>"
OVERVIEW = (
    "struct<target_audience:string,course_description:string,total_estimated_study_hours:double,"
    f"study_strategies:array<{STRATEGY}>,exam_day_tips:array<string>,prerequisites_detail:array<string>>"
)
COURSE = (
    f"certification_name string, exam_code string, overview {OVERVIEW}, domain_modules array<{MODULE}>,"
    " version int, validated_at timestamp, validation_status string, checkpoint_stage string,"
    " checkpoint_engine string, checkpoint_model string"
)

ACTION = (
    "action_id string, entity_type string, entity_id string, entity_path array<string>,"
    " action_type string, field_corrections map<string,string>, regenerate_prompt string,"
    " priority int, status string, created_at timestamp, applied_at timestamp, error string"
)
QUEUE_HEADER = "certification_name string, source_version int, target_version int, created_at timestamp"
ATTEMPT = (
    "learner_id string, capsule_id string, is_completed boolean, score int, time_spent int,"
    " answers map<string,array<string>>, completed_at timestamp"
)
QUESTION_TYPE = (
    "struct<fields:array<string>,choice_count:int,min_choices:int,scoring:string,description:string>"
)
ANNOTATIONS = "annotations array<struct<path:string,description:string>>"

# --- exam formats ---------------------------------------------------------------------------

DOMAIN_V2 = (
    "struct<name:string,weight_min_pct:double,weight_max_pct:double,weight_pct:double,"
    "description:string,source_type:string>"
)
ITEM_CLASS = (
    "struct<name:string,display_name:string,is_tei:boolean,interaction_model:string,"
    "allowed_context_types:array<string>,patient_presence:string,age_representation:array<string>,"
    "description:string,grading:string,estimated_percentage:double,source_type:string>"
)
COMPONENT = (
    "struct<name:string,display_name:string,description:string,adaptive:boolean,"
    "adaptive_algorithm:string,num_questions:int,num_questions_min:int,num_questions_max:int,"
    "pilot_unscored_items:int,time_limit_minutes:int,delivery_methods:array<string>,"
    f"passing_score:string,passing_score_source:string,domains:array<{DOMAIN_V2}>,item_classes:array<{ITEM_CLASS}>>"
)
FACT = (
    "struct<field:string,value:variant,source_type:string,source_title:string,source_url:string,confidence:string>"
)
EXAM_V2 = (
    "certification_name string, certification_code string, certifying_body string, exam_code string,"
    f" exam_components array<{COMPONENT}>, prerequisites array<string>, cost_usd double,"
    f" validity_years double, languages array<string>, recertification_policy string, source_facts array<{FACT}>"
)
