"""A small synthetic API description over the resources that the sample pages call."""

DOC = {
    "openapi": "3.1.0",
    "servers": [{"url": "http://localhost:7700"}],
    "security": [{"key": []}],
    "components": {
        "schemas": {
            "Base": {"type": "object", "properties": {"maxImport": {"type": "integer"}}, "required": ["maxImport"]},
            "Settings": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"type": "object", "properties": {"onQuery": {"type": "string"}, "order": {"$ref": "#/components/schemas/Order"}}}], "oneOf": [{"properties": {"useVector": {"type": "boolean"}}, "required": ["useVector"]}]},
            "Order": {"type": "string", "enum": ["asc", "desc", None]},
            "Loop": {"$ref": "#/components/schemas/Loop"},
        }
    },
    "paths": {
        "/{service}/{setting}": {
            "parameters": [{"name": "service", "in": "path", "required": True}, {"name": "setting", "in": "path", "required": True}],
            "get": {"operationId": "read", "parameters": [{"name": "limit", "in": "query"}], "responses": {"200": {}}},
            "patch": {"operationId": "change", "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Settings"}}}}, "responses": {"202": {}}},
            "delete": {"operationId": "drop", "deprecated": True, "security": [], "responses": {"204": {}}},
        },
        "/{service}/health": {"get": {"operationId": "health", "security": [], "responses": {"200": {}}}},
        "/tasks": {"post": {"operationId": "task", "requestBody": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Settings"}}}}}, "responses": {"202": {}}}},
    },
}
