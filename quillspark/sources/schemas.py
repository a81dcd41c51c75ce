"""Schemas of the stored tables and the fixed value lists of the domain."""

SOURCES = "project string, file_path string, qualified_name string, text string"

REPORT = (
    "summary string, projects array<struct<project_name string, framework string, num_agents int, num_tools int,"
    " test_modules array<struct<module_path string, file_path string, is_test_module boolean,"
    " test_functions array<string>>>>>"
)

PATTERN_ROWS = (
    "pattern_seq long, pattern_id string, pattern_name string, description string, confidence_score double,"
    " usage_count long, example_count long, created_at string, updated_at string"
)

VECTORS = "doc_id long, embedding array<float>, metadata map<string,string>"

PARAMETER = "struct<name:string,annotation:string>"

IMPORT = "struct<ordinal:int,from_statement:string,imports:array<string>>"

CLASS = (
    "struct<ordinal:int,class_name:string,bases:array<string>,decorators:array<string>,docstring:string,"
    "start_line:int,end_line:int>"
)

FUNCTION = (
    f"struct<ordinal:int,class_ordinal:int,name:string,parameters:array<{PARAMETER}>,return_type:string,"
    "decorators:array<string>,docstring:string,is_async:boolean,start_line:int,end_line:int,branches:int,"
    "asserts:int,bool_ops:int,bool_operators:int>"
)

HEADER = "struct<class_ordinal:int,name:string,decorators:array<string>>"

ARGUMENT = "struct<kind:string,text:string,keyword:string>"

CALL = (
    "struct<ordinal:int,function_ordinal:int,form:string,callee:string,receiver:string,receiver_form:string,"
    f"receiver_callee:string,args:array<{ARGUMENT}>,start_line:int,start_column:int,end_line:int,end_column:int,"
    "callee_is_function:boolean,callee_is_class:boolean,receiver_is_class:boolean>"
)

LAMBDA = "struct<ordinal:int,line:int,parent:string,parent_callee:string>"

ASSERT = "struct<ordinal:int,line:int,code:string,test:string>"

ASSIGNMENT = (
    "struct<ordinal:int,function_ordinal:int,variable:string,form:string,value:string,start_line:int,start_column:int,"
    "end_line:int,end_column:int>"
)

HEADERS = f"valid boolean, classes array<struct<class_name:string>>, functions array<{HEADER}>"

PARSED = (
    f"valid boolean, imports array<{IMPORT}>, classes array<{CLASS}>, functions array<{FUNCTION}>, calls array<{CALL}>,"
    f" lambdas array<{LAMBDA}>, asserts array<{ASSERT}>, assignments array<{ASSIGNMENT}>"
)
