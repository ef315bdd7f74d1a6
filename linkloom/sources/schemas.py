"""Schemas of the linking records. Maps keyed by entity are declared, never inferred, so keys don't become fields."""

SPEC = "array<struct<subsection:string,text:array<struct<specification:string,value:string>>>>"
ENTITIES = f"id long, product_name string, url string, product_category string, overview_section struct<description:string,features:array<struct<header:string,description:string>>>, image_path array<string>, Spec {SPEC}, similar_product_id array<long>, product_id_with_similar_image array<long>"
MENTIONS = "review_id long, header string, body string, mention string, review_image_path array<string>, attribute map<string,string>, gold_entity_info struct<id:long,product_category:string>"
REVIEW = "struct<id:long,user:string,header:string,body:string,rating:string,recommendation:string,feedback:struct<number_helpful:int,number_unhelpful:int>,product_images:array<string>,image_url:array<string>,image_path:array<string>>"
PRODUCTS_WITH_REVIEWS = f"id long, url string, product_name string, product_category string, reviews array<{REVIEW}>"
TEXT_SCORE = "struct<idx:int,cross_score:double,bi_score:double,cross_score_sigmoid:double>"
RETRIEVED = f"{MENTIONS}, text_score_dict map<string,{TEXT_SCORE}>, desc_score_dict map<string,{TEXT_SCORE}>, image_score_dict map<string,struct<idx:int,score:double>>"
NLI = "review_id long, nli_score map<string,map<string,struct<score:double,nli_label:int,predicted_nli_label:int>>>"
QRELS = "TOPIC string, ITERATION int, `DOCUMENT#` string, RELEVANCY int"
PREDICTIONS = "query_id long, predict_entity_position int, gold_entity_position int, entity_id_list string, order_list string, text_score string, image_score string"
ANNOTATIONS = "review_id long, human_predict int"
GOLD_RECORDS = "review_id long, review_image_path array<string>, product_category string, overview_section struct<description:string>, gold_entity_info struct<id:long>"
