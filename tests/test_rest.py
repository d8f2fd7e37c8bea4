import json
import threading
from urllib.request import Request, urlopen

from objectlake.rest import Api, server
from objectlake.store import ObjectStore


def test_routes(spark, tmp_path):
    api = Api(ObjectStore(spark, str(tmp_path / "s")))
    steps = [
        ("GET", "/v1/health", "", 200, {"status": "ok"}),
        ("POST", "/v1/classes", '{"name":"c"}', 201, {"name": "c", "project": ""}),
        ("POST", "/v1/classes", '{"name":"c"}', 409, None),
        ("POST", "/v1/classes", '{"name":"bad name!"}', 400, None),
        ("POST", "/v1/classes", '{"name":""}', 400, None),
        ("GET", "/v1/classes", "", 200, {"classes": ["c"], "project": ""}),
        ("GET", "/v1/classes/c", "", 200, {"name": "c", "project": ""}),
        ("GET", "/v1/classes/x", "", 404, None),
        ("POST", "/v1/classes/c/objects", '{"n":1,"id":8}', 201, {"id": 1, "n": 1}),
        ("POST", "/v1/classes/c/objects", "[1]", 400, None),
        ("POST", "/v1/classes/x/objects", "{}", 404, None),
        ("POST", "/v1/classes/c/objects/bulk", '[{"n":2},{"n":3}]', 201, {"ids": [2, 3], "count": 2}),
        ("POST", "/v1/classes/c/objects/bulk", '[{"n":2},3]', 400, None),
        ("POST", "/v1/classes/c/objects/bulk", "[]", 201, {"ids": [], "count": 0}),
        ("GET", "/v1/classes/c/objects?eq.n=3", "", 200, {"objects": [{"id": 3, "n": 3}], "count": 1, "limit": 100, "offset": 0}),
        ("GET", "/v1/classes/c/objects?limit=1&offset=1", "", 200, {"objects": [{"id": 2, "n": 2}], "count": 1, "limit": 1, "offset": 1}),
        ("PUT", "/v1/classes/c/objects/2", '{"m":true}', 200, {"id": 2, "m": True}),
        ("GET", "/v1/classes/c/objects/2", "", 200, {"id": 2, "m": True}),
        ("GET", "/v1/classes/c/objects/abc", "", 400, None),
        ("GET", "/v1/classes/c/objects/999", "", 404, None),
        ("DELETE", "/v1/classes/c", "", 409, None),
        ("DELETE", "/v1/classes/c/objects/1", "", 204, None),
        ("GET", "/v1/projects", "", 200, {"projects": [""]}),
        ("GET", "/nowhere", "", 404, None),
    ]
    for method, path, body, status, want in steps:
        got = api.handle(method, path, body)
        assert got[0] == status and (want is None or got[1] == want), (method, path, got)
        assert status < 400 or "error" in got[1]
    assert api.handle("GET", "/v1/classes", "", " p ")[1] == {"classes": [], "project": "p"}
    assert api.handle("GET", "/v1/stats")[1]["num_classes"] == 1


def test_server(spark, tmp_path):
    http = server(ObjectStore(spark, str(tmp_path / "s")), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    with urlopen(Request(f"{base}/v1/classes", b'{"name":"ex"}', {"X-Project": "p"})) as answer:
        assert answer.status == 201 and json.load(answer) == {"name": "ex", "project": "p"}
    http.shutdown()
    http.server_close()
