"""Errors, each with the status that a service would answer with."""


class PathError(Exception):
    status = 500


class BadRequest(PathError):
    status = 400


class Forbidden(PathError):
    status = 403


class NotFound(PathError):
    status = 404


class Conflict(PathError):
    status = 409


class Unsupported(PathError):
    status = 415
