"""Column functions: URIs, capabilities, tags, dynamic payloads, geometry, tensors, detections and poses."""
