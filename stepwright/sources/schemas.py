"""Fixed schemas of the JSON files the jobs read."""

# Scores stay text, so that an integer keeps printing as an integer.
NODE = "struct<children:array<string>,thought:string,reasoning:string,score:string>"
THOUGHT_TREE = f"initial_question string, user_profile string, thought_tree map<string,{NODE}>"
LABEL = "array<struct<critique:string,score:double>>"
PROCESS = (f"idx bigint, question string, preference string, process string, "
           f"label {LABEL}, final_score string")
RESPONSES = ("user_profile string, initial_question string, "
             "response_list array<struct<response:array<string>,answer:string,score:double>>")
GENERATION = "item_id bigint, preference string, question string, response_to_q string"
CHAT_REPLY = ("struct<choices:array<struct<text:string,"
              "message:struct<role:string,content:string>>>>")
